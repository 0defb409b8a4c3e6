"""Expressions on texts and tokens."""
