"""Bulk building of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.errors import EdgeAlreadyExists, InvalidNode, UnsupportedOperation
from sparkquiver.graph import Graph
from sparkquiver.operators import relops
from sparkquiver.schema import GraphOptions, check_u16

_STAGED = "src long, dst long, relation int, flags int, ord long"


class GraphBuilder:
    """Stages nodes and edges; ``freeze`` sorts them, numbers edges and makes the graph.

    Edges added one by one are checked at once. Those of a DataFrame are checked by ``freeze``, which leaves the
    builder usable if it fails.
    """

    def __init__(self, spark: SparkSession, options: GraphOptions | None = None):
        self.spark, self.options = spark, options or GraphOptions()
        self._nodes, self._ord = 0, 0
        self._rows: list[tuple] = []
        self._keys: set[tuple[int, int]] = set()
        self._frames: list[DataFrame] = []
        self._node_frames: list[DataFrame] = []
        self._frozen = False

    def _open(self) -> None:
        if self._frozen:
            raise UnsupportedOperation("the builder is frozen")

    def add_node(self) -> int:
        return self.add_nodes(1)

    def add_nodes(self, count: int) -> int:
        """Stage ``count`` nodes with consecutive ids and return the first."""
        self._open()
        first = self._nodes
        self._nodes += count
        return first

    def add_node_ids(self, ids: DataFrame) -> None:
        """Stage nodes with ids of one's own (id)."""
        self._open()
        self._node_frames.append(ids.select(F.col("id").cast("long").alias("id")))

    def add_edge(self, source: int, destination: int, relation: int = 0, flags: int = 0) -> None:
        self._open()
        check_u16(relation, flags)
        for node in (source, destination):
            if not self._node_frames and not 0 <= node < self._nodes:
                raise InvalidNode(node)
        if not self.options.multigraph:
            if (source, destination) in self._keys:
                raise EdgeAlreadyExists((source, destination))
            self._keys.add((source, destination))
        self._rows.append((source, destination, relation, flags, self._ord))
        self._ord += 1

    def add_edges_df(self, edges: DataFrame) -> None:
        """Stage edges (src, dst, relation, flags, ord); ``ord`` orders parallel edges."""
        self._open()
        self._frames.append(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("relation").cast("int"), F.col("flags").cast("int"), F.col("ord").cast("long")))

    def freeze(self) -> Graph:
        """The graph; afterwards the builder refuses everything."""
        self._open()
        ids = reduce(DataFrame.unionByName, self._node_frames, self.spark.range(self._nodes))
        edges = reduce(DataFrame.unionByName, self._frames, self.spark.createDataFrame(self._rows, _STAGED))
        if self._frames or self._node_frames:
            ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
            if not ends.join(ids, "id", "left_anti").isEmpty():
                raise InvalidNode
            if not self.options.multigraph and not relops.multiplicity(edges).filter("n > 1").isEmpty():
                raise EdgeAlreadyExists
        nodes = ids.distinct().select("id", F.lit(False).alias("removed"))
        if self.options.multigraph:
            edges = relops.number_edges(edges, "dst", "ord")
            nodes = nodes.join(relops.counters(edges), "id", "left").select("id", "removed", F.coalesce("next_edge_id", F.lit(1)).cast("long").alias("next_edge_id"))
        else:
            edges = edges.withColumn("edge_id", F.lit(None).cast("long"))
            nodes = nodes.withColumn("next_edge_id", F.lit(1).cast("long"))
        out = Graph.adopt(self.spark, nodes, edges.drop("ord"), self.options)
        self._frozen = True
        self._rows, self._keys, self._frames, self._node_frames = [], set(), [], []
        return out
