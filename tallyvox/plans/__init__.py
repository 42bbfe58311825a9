"""Whole job graphs built from the operators."""
