"""The two tables of a graph, and their limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("removed", T.BooleanType(), False), T.StructField("next_edge_id", T.LongType(), False)])
EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False), T.StructField("relation", T.IntegerType(), False),
    T.StructField("flags", T.IntegerType(), False), T.StructField("edge_id", T.LongType(), True)])
MAX_U16 = (1 << 16) - 1
#: Edge ids run from 1 to one less than this.
EDGE_ID_END = (1 << 32) - 1


@dataclass(frozen=True)
class GraphOptions:
    """``multigraph`` is fixed for a graph's life. ``degree_limit`` bounds each node's edges on either side."""

    multigraph: bool = False
    degree_limit: int | None = None


@dataclass(frozen=True)
class EdgeInput:
    """One edge of a batch."""

    destination: int
    relation: int = 0
    flags: int = 0

    def __post_init__(self):
        check_u16(self.relation, self.flags)


def check_u16(*values: int) -> None:
    for v in values:
        if not 0 <= v <= MAX_U16:
            raise ValueError(f"{v} is not in 0..{MAX_U16}")
