"""Operators on grid tables."""
