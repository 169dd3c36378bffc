"""Connected components of a distributed edge list by alternating large-star and small-star rounds.

Before each round every task contracts its own edges to stars, which leaves few rounds. Minima are combined before
the shuffle, and the joins that follow them can be split where a node has very many edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store
from sparkquiver.llm._text import tidy


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, (up := new[new])):
            new = up
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            node, root = roots(b.column(0).to_numpy(), b.column(1).to_numpy())
            own = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own])], ["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root) of every node of ``edges`` (two long columns) that is not the smallest of its component."""
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")
    edges = store.put(edges.mapInArrow(tidy(_contract), "u long, v long").distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = store.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = store.put(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = store.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = store.put(small.select("e.u", "e.v").filter("u > v").mapInArrow(tidy(_contract), "u long, v long").distinct())
        found = _mark(new)
        store.drop(edges, low, large, low2)
        if found == mark:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, mark = new, found
