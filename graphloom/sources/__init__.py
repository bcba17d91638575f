"""Readers and writers of graphs and results."""
