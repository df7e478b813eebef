"""Operators on the three normalized tables."""
