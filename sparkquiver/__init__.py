"""A directed-graph engine whose nodes and edges are Spark DataFrames."""
