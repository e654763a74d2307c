"""Operators on series."""
