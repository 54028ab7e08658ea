"""Operators for training-data work: sketches over huge columns and preparation of texts."""
