"""stockroom package."""
