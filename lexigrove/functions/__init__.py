"""Scalar column functions and constant tables."""
