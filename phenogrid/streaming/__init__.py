"""Incremental upkeep of the presence table."""
