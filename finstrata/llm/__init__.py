"""Operators that prepare text and entities for model training. Nothing outside imports this package."""
