"""Lazy DataFrame operators; none of them collects rows that grow with the input."""
