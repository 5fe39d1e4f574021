"""Spatiotemporal occurrence analytics as plain Spark DataFrame operators."""
