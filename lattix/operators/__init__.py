"""Relational operators over matrices, vectors, masks and graphs."""
