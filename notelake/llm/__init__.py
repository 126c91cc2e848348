"""Operators for preparing language-model training text; nothing outside this package imports it."""
