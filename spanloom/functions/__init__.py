"""Column types and scalar helpers."""
