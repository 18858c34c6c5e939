"""Structured Streaming forms of the array operators."""
