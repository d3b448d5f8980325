"""Composed analyses and the query registry."""
