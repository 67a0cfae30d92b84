"""Operators on sequence tables."""
