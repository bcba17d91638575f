"""Comparisons of results."""
