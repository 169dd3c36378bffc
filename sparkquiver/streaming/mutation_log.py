"""Applying a stream of mutations to a graph, one version for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkquiver.graph import Graph

LOG_SCHEMA = "op string, src long, dst long, relation int, flags int, ord long"


class MutationLog:
    """Rows (op, src, dst, relation, flags, ord) with op add_edge, remove_edge or remove_node (of src).

    Within a micro-batch edges are added, then edges removed, then nodes: all or nothing, as one version that also
    holds the epoch under the log's ``name``. So a batch that the stream repeats changes nothing, whether it is this
    object that sees it again or a new one, and a batch that fails has left nothing behind.
    """

    def __init__(self, graph: Graph, name: str = "log"):
        self.graph, self.name = graph, name

    @property
    def epoch(self) -> int:
        return self.graph.epoch(self.name)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        self.graph.apply(batch.filter("op = 'add_edge'").select("src", "dst", "relation", "flags", "ord"),
                         batch.filter("op = 'remove_edge'").select("src", "dst"),
                         batch.filter("op = 'remove_node'").select(F.col("src").alias("id")), self.name, epoch)

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follow a streaming DataFrame of ``LOG_SCHEMA``."""
        return log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
