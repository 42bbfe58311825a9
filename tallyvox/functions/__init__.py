"""Column-returning text and score functions."""
