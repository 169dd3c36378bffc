"""Graphs that follow a stream of mutations."""
