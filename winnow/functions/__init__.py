"""Strict parsers from JSON values to typed values."""
