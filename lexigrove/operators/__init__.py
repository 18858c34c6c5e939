"""Relational operators over annotations."""
