"""Operators for large training-text tables; nothing else in the library imports this package."""
