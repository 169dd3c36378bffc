"""Traversals and cycle detection with cooperative cancellation.

Graphs of up to ``Context.most_edges`` visible edges are handled by one task with array kernels, as rounds of
joins would cost far more. Larger ones are handled by rounds of joins over the distributed edges; each round's
state is written, so lineage stays short and lost executors cost one round at most. Depth-first order of larger
ones is one task too, which keeps the edges in a file of its own.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.errors import Cancelled, UnsupportedOperation
from sparkquiver.functions.kernels import Csr, FileCsr
from sparkquiver.plans import storage


#: Rounds after which the tables of nodes seen so far are made one.
MERGE_ROUNDS = 8
#: Edges that one task holds in memory.
LOCAL_EDGES = 2_000_000


class CancelToken:
    """A sticky, thread-safe flag; operations look at it between rounds."""

    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def is_cancelled(self) -> bool:
        return self._event.is_set()


@dataclass
class Context:
    """How a call runs. ``local_edges``: a bound of the caller's on the edges that one task takes; depth-first order
    refuses to go beyond it. Without one a task holds up to ``LOCAL_EDGES`` in memory, and nothing is refused."""

    cancel_token: CancelToken | None = None
    local_edges: int | None = None

    @property
    def most_edges(self) -> int:
        return LOCAL_EDGES if self.local_edges is None else self.local_edges

    def check(self) -> None:
        if self.cancel_token is not None and self.cancel_token.is_cancelled:
            raise Cancelled


def _in_one_task(edges: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the (src, dst) arrays of all edges, of which the caller has checked the number."""

    def task(table):
        t = table.combine_chunks()
        return run(t.column("src").to_numpy(), t.column("dst").to_numpy())

    return edges.select("src", "dst").groupBy().applyInArrow(task, schema)


def _small(edges: DataFrame, ctx: Context) -> bool:
    return edges.limit(ctx.most_edges + 1).count() <= ctx.most_edges


def bfs(edges: DataFrame, start: int, ctx: Context | None = None) -> DataFrame:
    """(pos, id, level) of all nodes that ``start``, which must be live, reaches over visible ``edges``.

    Nodes come in queue order: by level, then by the place of their first-queued parent, then by id.
    """
    ctx = ctx or Context()
    ctx.check()
    spark = edges.sparkSession
    if edges.filter(F.col("src") == start).isEmpty():
        return spark.sql(f"SELECT 0L AS pos, CAST({int(start)} AS LONG) AS id, 0L AS level")
    if _small(edges, ctx):

        def run(src, dst):
            order, level = Csr(src, dst).bfs(start)
            return pa.table({"pos": pa.array(range(len(order)), pa.int64()), "id": order, "level": level})

        return _in_one_task(edges, run, "pos long, id long, level long")
    folder = storage.new_folder(spark, "bfs")
    edges = storage.written(edges.select("src", "dst").distinct(), f"{folder}/edges")  # once, not in every round
    # "place" grows in queue order within a level; it need not be dense until the end.
    front = storage.written(spark.sql(f"SELECT CAST({int(start)} AS LONG) AS id, 0L AS place, 0L AS level"), f"{folder}/0")
    seen, level = front, 0
    while not front.isEmpty():
        ctx.check()
        level += 1
        reached = edges.join(front.select(F.col("id").alias("src"), "place"), "src").groupBy("dst").agg(F.min("place").alias("parent"))
        fresh = reached.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        # A range-partitioned sort; the ids follow the order across its partitions.
        ordered = fresh.orderBy("parent", "dst").select(F.col("dst").alias("id"), F.monotonically_increasing_id().alias("place"), F.lit(level).cast("long").alias("level"))
        front = storage.written(ordered, f"{folder}/{level}")
        seen = seen.unionByName(front)
        if level % MERGE_ROUNDS == 0:
            seen = storage.written(seen, f"{folder}/seen-{level}")
    return _dense(seen)


def _dense(seen: DataFrame) -> DataFrame:
    """Positions 0, 1, ... by (level, place), from counts of the runs of places: few rows, one per level and task."""
    from pyspark.sql import Window

    run = F.shiftright("place", 33)
    counts = seen.groupBy("level", run.alias("run")).agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = F.sum("n").over(Window.orderBy("level", "run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("level", "run", "low", F.coalesce(before, F.lit(0)).alias("start"))
    return (seen.withColumn("run", run).join(starts, ["level", "run"])
            .select((F.col("start") + F.col("place") - F.col("low")).alias("pos"), "id", "level"))


def reachable(edges: DataFrame, start: int, ctx: Context | None = None) -> DataFrame:
    return bfs(edges, start, ctx).select("id")


def dfs(edges: DataFrame, start: int, ctx: Context | None = None) -> DataFrame:
    """(pos, id) in pre-order of a recursive depth-first search with neighbours in ascending order.

    The order is inherently sequential, so one task walks it. Of a graph too large for its memory it holds some 60
    bytes a node, and the edges in a file. Only a bound that the caller gave (``local_edges``) is refused beyond.
    """
    ctx = ctx or Context()
    ctx.check()
    spark = edges.sparkSession
    if edges.filter(F.col("src") == start).isEmpty():
        return spark.sql(f"SELECT 0L AS pos, CAST({int(start)} AS LONG) AS id")
    if not _small(edges, ctx):
        if ctx.local_edges is None:
            return _dfs_by_file(edges, start, ctx)
        near = reachable(edges, start, ctx)
        edges = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi")
        ctx.check()
        if not _small(edges, ctx):
            raise UnsupportedOperation(f"depth-first order over more than {ctx.local_edges} reachable edges")

    def run(src, dst):
        order = Csr(src, dst).dfs(start)
        return pa.table({"pos": pa.array(range(len(order)), pa.int64()), "id": order})

    return _in_one_task(edges, run, "pos long, id long")


def _dfs_by_file(edges: DataFrame, start: int, ctx: Context) -> DataFrame:
    """``dfs`` by one task that streams the edges, sorted by all tasks before, into a file."""
    # "place" is the edge's place in the order, with gaps between tasks; it puts right whatever order the files are read in.
    ordered = edges.select("src", "dst").orderBy("src", "dst").withColumn("place", F.monotonically_increasing_id())
    ordered = storage.written(ordered, f"{storage.new_folder(edges.sparkSession, 'dfs')}/edges")
    ctx.check()

    def task(batches):
        with FileCsr() as graph:
            for b in batches:
                graph.add(*(b.column(c).to_numpy() for c in ("place", "src", "dst")))
            at = 0
            for ids in graph.dfs(start):
                yield pa.record_batch({"pos": pa.array(range(at, at + len(ids)), pa.int64()), "id": pa.array(ids)})
                at += len(ids)

    # Walked once: whoever reads the order, and whatever reads it twice, reads what was written.
    return storage.written(ordered.coalesce(1).mapInArrow(task, "pos long, id long"), storage.new_folder(edges.sparkSession, "dfs"))


def has_cycle(edges: DataFrame, ctx: Context | None = None) -> bool:
    """Whether visible ``edges`` hold a directed cycle; a self-loop is one."""
    ctx = ctx or Context()
    ctx.check()
    spark = edges.sparkSession
    edges = edges.select("src", "dst")
    if not _small(edges, ctx):
        folder, rounds = storage.new_folder(spark, "cycle"), 0
        edges = storage.written(edges.distinct(), f"{folder}/0")
        if not edges.filter("src = dst").isEmpty():
            return True
        n = edges.count()
        while n > ctx.most_edges:
            ctx.check()
            # Peel: an edge on a cycle starts where another ends, and ends where another starts. Two layers from each side a round.
            left = edges
            for _ in range(2):
                left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            rounds += 1
            edges, before = storage.written(left, f"{folder}/{rounds}"), n
            n = edges.count()
            if n == before:
                return True
        if not n:
            return False
    ctx.check()

    def run(src, dst):
        return pa.table({"cyclic": [Csr(src, dst).has_cycle()]})

    found = _in_one_task(edges, run, "cyclic boolean").first()
    return bool(found and found["cyclic"])
