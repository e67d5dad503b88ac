"""Operators for preparing training text; nothing in the core imports this package."""
