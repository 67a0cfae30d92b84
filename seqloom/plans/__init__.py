"""Databases, searches and the registered queries."""
