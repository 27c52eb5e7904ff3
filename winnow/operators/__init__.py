"""Operators of leaf predicates, and the profiles that group them by column type."""
