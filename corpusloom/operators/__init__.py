"""Operators over documents, vectors and graphs."""
