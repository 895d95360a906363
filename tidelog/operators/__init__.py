"""Relational operators over incident tables."""
