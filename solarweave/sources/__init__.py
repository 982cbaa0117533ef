"""Readers, writers and the columns that they are keyed by."""
