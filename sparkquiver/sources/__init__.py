"""Graphs derived from tables."""
