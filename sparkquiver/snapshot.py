"""Reads of a graph: snapshots of one version, and sessions that follow the head."""

from __future__ import annotations

import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.errors import CorruptGraph, InvalidNode, UnsupportedOperation
from sparkquiver.operators import algorithms, relops, validate
from sparkquiver.operators.algorithms import Context
from sparkquiver.plans.versions import Version, VersionStore
from sparkquiver.results import EdgeRef, Violation


class NodeIterator:
    """Local iteration over a read's rows; ``materialize`` takes all that are left, after which ``next`` is None.

    The version that is read stays pinned until the iterator ends, is closed or is dropped, so what it has still to
    read cannot be reclaimed.
    """

    def __init__(self, df: DataFrame, make=lambda r: r[0], pinned: tuple[VersionStore, Version] | None = None):
        self.df, self._make = df, make
        self._rows: Iterator | None = None
        self._over = False
        self._unpin = weakref.finalize(self, VersionStore.unpin, *pinned) if pinned else lambda: None

    def next(self):
        if self._over:
            return None
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        row = next(self._rows, None)
        if row is None:
            self.deinit()
            return None
        return self._make(row)

    def __iter__(self):
        while (x := self.next()) is not None:
            yield x

    def materialize(self) -> list:
        out = list(self)
        self.deinit()
        return out

    def deinit(self) -> None:
        self._over, self._rows = True, None
        self._unpin()


class _Reads:
    """Reads of whatever version ``_version`` names."""

    _store: VersionStore
    multigraph: bool

    def _version(self) -> Version:
        raise NotImplementedError

    @property
    def nodes(self) -> DataFrame:
        return self._version().nodes(self._store.spark)

    @property
    def edges(self) -> DataFrame:
        return self._version().edges(self._store.spark)

    @property
    def visible(self) -> DataFrame:
        v = self._version()
        return relops.visible(v.nodes(self._store.spark), v.edges(self._store.spark), clean=not v.removed_count)

    def node_count(self) -> int:
        """Nodes ever added, removed ones included."""
        return self._version().node_count

    def has_node(self, node: int) -> bool:
        return self._has(node, self._version())

    def has_edge(self, source: int, destination: int) -> bool:
        return not self._ends(source, "src", "dst").filter(F.col("dst") == destination).isEmpty() and self.has_node(source)

    def _has(self, node: int, v: Version) -> bool:
        return not relops.live(v.nodes(self._store.spark)).filter(F.col("id") == node).isEmpty()

    def _live(self, node: int, v: Version | None = None) -> None:
        if not self._has(node, v or self._version()):
            raise InvalidNode(node)

    def _ends(self, node: int, near: str, far: str, v: Version | None = None) -> DataFrame:
        """The visible edges of one node on one side: the filter on the node reaches the files."""
        v, spark = v or self._version(), self._store.spark
        rows = v.edges(spark).filter(F.col(near) == node)
        if v.removed_count:
            rows = rows.join(relops.removed(v.nodes(spark)).withColumnRenamed("id", far), far, "left_anti")
        return rows

    def _iterate(self, node: int, near: str, far: str, make=lambda r: r[0], *columns: str) -> NodeIterator:
        v = self._store.pin(self._version())
        try:
            self._live(node, v)
            rows = self._ends(node, near, far, v).orderBy(far, "edge_id").select(*(columns or (far,)))
            return NodeIterator(rows, make, (self._store, v))
        except BaseException:
            self._store.unpin(v)
            raise

    def neighbors_df(self, node: int) -> DataFrame:
        self._live(node)
        return self._ends(node, "src", "dst").orderBy("dst", "edge_id").select(F.col("dst").alias("id"))

    def in_neighbors_df(self, node: int) -> DataFrame:
        self._live(node)
        return self._ends(node, "dst", "src").orderBy("src", "edge_id").select(F.col("src").alias("id"))

    def neighbors(self, node: int) -> NodeIterator:
        """Out-neighbours by ascending id; parallel edges repeat."""
        return self._iterate(node, "src", "dst")

    def in_neighbors(self, node: int) -> NodeIterator:
        return self._iterate(node, "dst", "src")

    def out_degree(self, node: int) -> int:
        self._live(node)
        return self._ends(node, "src", "dst").count()

    def in_degree(self, node: int) -> int:
        self._live(node)
        return self._ends(node, "dst", "src").count()


class ReadSession(_Reads):
    """Each read sees the head of its moment. Opening one reads nothing. Versions that it has read stay until it closes."""

    def __init__(self, store: VersionStore, multigraph: bool):
        self._store, self.multigraph = store, multigraph
        first = store.pin()
        self._pins: dict[int, Version] | None = {first.number: first}

    def _version(self) -> Version:
        self._store.check_open()
        if self._pins is None:
            raise UnsupportedOperation("the session is closed")
        v = self._store.pin()
        if v.number in self._pins:
            self._store.unpin(v)
        else:
            self._pins[v.number] = v
        return v

    def deinit(self) -> None:
        for v in (self._pins or {}).values():
            self._store.unpin(v)
        self._pins = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.deinit()


class ReadSnapshot(_Reads):
    """Reads of one version, whatever is written later."""

    def __init__(self, store: VersionStore, multigraph: bool, context: Context | None = None):
        self._store, self.multigraph, self.context = store, multigraph, context
        if context:
            context.check()
        self._pin: Version | None = store.pin()

    def _version(self) -> Version:
        if self._pin is None:
            raise UnsupportedOperation("the snapshot is closed")
        return self._pin

    def deinit(self) -> None:
        if self._pin is not None:
            self._store.unpin(self._pin)
            self._pin = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.deinit()

    def live_node_count(self) -> int:
        v = self._version()
        return v.node_count - v.removed_count

    def neighbors_materialized(self, node: int, context: Context | None = None) -> list[int]:
        (context or Context()).check()
        return self.neighbors(node).materialize()

    def in_neighbors_materialized(self, node: int, context: Context | None = None) -> list[int]:
        (context or Context()).check()
        return self.in_neighbors(node).materialize()

    def out_edges_df(self, node: int) -> DataFrame:
        if not self.multigraph:
            raise UnsupportedOperation("edge ids, relations and flags are read in multigraphs only")
        self._live(node)
        return self._ends(node, "src", "dst").orderBy("dst", "edge_id").select("edge_id", "dst", "relation", "flags")

    def out_edges(self, node: int) -> NodeIterator:
        if not self.multigraph:
            raise UnsupportedOperation("edge ids, relations and flags are read in multigraphs only")
        return self._iterate(node, "src", "dst", lambda r: EdgeRef(*r), "edge_id", "dst", "relation", "flags")

    def bfs_df(self, start: int, context: Context | None = None) -> DataFrame:
        self._live(start)
        return algorithms.bfs(self.visible, start, context or self.context)

    def bfs(self, start: int, context: Context | None = None) -> list[int]:
        """Ids in breadth-first order. Use ``bfs_df`` where they may be too many for the driver."""
        return [r["id"] for r in self.bfs_df(start, context).orderBy("pos").collect()]

    def dfs_df(self, start: int, context: Context | None = None) -> DataFrame:
        self._live(start)
        return algorithms.dfs(self.visible, start, context or self.context)

    def dfs(self, start: int, context: Context | None = None) -> list[int]:
        return [r["id"] for r in self.dfs_df(start, context).orderBy("pos").collect()]

    def has_cycle(self, context: Context | None = None) -> bool:
        return algorithms.has_cycle(self.visible, context or self.context)

    def violations(self) -> DataFrame:
        return validate.violations(self.nodes, self.edges, self.multigraph, check_counters=False)

    def validate(self) -> None:
        found = self.violations().limit(1).collect()
        if found:
            raise CorruptGraph(Violation(*found[0]))

    def debug_validate(self, context: Context | None = None, limit: int | None = None) -> list[Violation]:
        """All violations, or up to ``limit``. Use ``violations`` where they may be too many for the driver."""
        (context or Context()).check()
        found = self.violations()
        return [Violation(*r) for r in (found if limit is None else found.limit(limit)).collect()]
