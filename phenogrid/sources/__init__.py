"""Readers and writers of archives, tables, labels and reports."""
