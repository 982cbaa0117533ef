"""Operators for preparing training text. Nothing outside this subpackage imports it."""
