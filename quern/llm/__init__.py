"""Operators that prepare texts for language models. Nothing outside imports this package."""
