"""Versions of a graph and the storage they are written to."""
