"""Operators on training text. Nothing outside this subpackage imports it."""
