"""Operators that prepare large text and record collections for model training."""
