"""A mutable directed graph over immutable versions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.errors import CorruptGraph, DegreeLimitReached, EdgeAlreadyExists, EdgeIdExhausted, InvalidNode, UnsupportedOperation
from sparkquiver.operators import relops, validate
from sparkquiver.operators.algorithms import Context
from sparkquiver.plans import storage
from sparkquiver.plans.versions import Version, VersionStore
from sparkquiver.results import DebtStats, NodeRemovalSummary, RepairFlushSummary, RepairNodeSummary, StorageStats, Violation
from sparkquiver.schema import EDGE_ID_END, EdgeInput, GraphOptions, check_u16
from sparkquiver.snapshot import ReadSession, ReadSnapshot


class Graph:
    """Simple or multigraph; edges are unique by (source, destination) in simple mode.

    Every mutation writes its own change as a new version. Prefer batches (``add_nodes``, ``add_edges``,
    ``add_edges_df``, ``remove_nodes_df``) to single calls, as each call runs Spark jobs.
    """

    def __init__(self, spark: SparkSession, options: GraphOptions | None = None, folder: str | None = None):
        """A new graph, or the one that another driver left in ``folder``."""
        self.spark, self.options = spark, options or GraphOptions()
        self._store = VersionStore(spark, folder)

    # -- reads ---------------------------------------------------------------

    @property
    def multigraph(self) -> bool:
        return self.options.multigraph

    @property
    def nodes(self) -> DataFrame:
        return self._store.head.nodes(self.spark)

    @property
    def edges(self) -> DataFrame:
        """Physical edges, with those to removed nodes that are not repaired yet."""
        return self._store.head.edges(self.spark)

    @property
    def visible(self) -> DataFrame:
        v = self._store.head
        return relops.visible(v.nodes(self.spark), v.edges(self.spark), clean=not v.removed_count)

    def node_count(self) -> int:
        return 0 if self._store.closed else self._store.head.node_count

    def edge_count(self) -> int:
        return 0 if self._store.closed else self.visible.count()

    def has_node(self, node: int) -> bool:
        return not self._store.closed and not relops.live(self.nodes).filter(F.col("id") == node).isEmpty()

    def has_edge(self, source: int, destination: int) -> bool:
        return not self.visible.filter((F.col("src") == source) & (F.col("dst") == destination)).isEmpty()

    def snapshot(self, context: Context | None = None) -> ReadSnapshot:
        self._store.check_open()
        return ReadSnapshot(self._store, self.multigraph, context)

    def read_session(self) -> ReadSession:
        self._store.check_open()
        return ReadSession(self._store, self.multigraph)

    # -- nodes ---------------------------------------------------------------

    def add_node(self) -> int:
        return self.add_nodes(1)

    def add_nodes(self, count: int) -> int:
        """Add ``count`` nodes with consecutive ids and return the first."""
        with self._store.writing() as v:
            first = v.next_id
            if count:
                self._store.publish(v, {"nodes": self.spark.range(first, first + count)}, node_count=v.node_count + count, next_id=first + count)
            return first

    def remove_node(self, node: int) -> NodeRemovalSummary:
        """Mark a node removed. Its edges disappear at once; its neighbours keep tombstones until they are repaired."""
        with self._store.writing() as v:
            self._ensure_live(v, node)
            # The filter on the one id reaches the files of the edges.
            own, ids = v.edges(self.spark).filter((F.col("src") == node) | (F.col("dst") == node)), self.spark.range(node, node + 1)
            out = relops.removal_summary(v.nodes(self.spark), own, ids).first()
            gone = relops.removed(v.nodes(self.spark)).unionByName(ids)
            self._store.publish(v, {"removed": ids, "deleted": self._dead(own, gone)}, removed_count=v.removed_count + 1)
            return NodeRemovalSummary(out["removed_visible_edges"], out["related_live_nodes_touched"], out["left_repair_debt"])

    def remove_nodes_df(self, ids: DataFrame) -> int:
        """Remove all nodes of ``ids`` (id) or none: InvalidNode if one of them is not live."""
        with self._store.writing() as v:
            ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
            n = ids.count()
            if ids.join(relops.live(v.nodes(self.spark)), "id", "left_semi").count() != n:
                raise InvalidNode
            if n:
                gone = relops.removed(v.nodes(self.spark)).unionByName(ids)
                self._store.publish(v, {"removed": ids, "deleted": self._dead(self._touching(v.edges(self.spark), ids), gone)}, removed_count=v.removed_count + n)
            return n

    @staticmethod
    def _touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
        """Edges with an end among ``ids``; those with both come twice."""
        return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))

    @staticmethod
    def _dead(edges: DataFrame, gone: DataFrame) -> DataFrame:
        """Deletions of edges between removed nodes: no side is left that keeps them, so they go at once."""
        both = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return both.select("src", "dst", F.lit(None).cast("long").alias("edge_id")).distinct()

    # -- edges ---------------------------------------------------------------

    def _state(self, v: Version, *nodes: int) -> dict:
        return {r["id"]: r for r in v.nodes(self.spark).filter(F.col("id").isin(*nodes)).collect()}

    def _ensure_live(self, v: Version, node: int) -> None:
        found = self._state(v, node).get(node)
        if found is None or found["removed"]:
            raise InvalidNode(node)

    def _ends(self, v: Version, source: int, destination: int) -> dict:
        found = self._state(v, source, destination)
        for check in (lambda r: r is None, lambda r: r["removed"]):
            for node in (source, destination):
                if check(found.get(node)):
                    raise InvalidNode(node)
        return found

    def add_edge(self, source: int, destination: int, relation: int = 0, flags: int = 0) -> None:
        self._add(source, destination, relation, flags)

    def add_edge_with_id(self, source: int, destination: int, relation: int = 0, flags: int = 0) -> int:
        """Add an edge to a multigraph and return its id, the next one of its source."""
        if not self.multigraph:
            raise UnsupportedOperation("edge ids exist in multigraphs only")
        return self._add(source, destination, relation, flags)

    def _add(self, source: int, destination: int, relation: int, flags: int) -> int:
        check_u16(relation, flags)
        with self._store.writing() as v:
            found = self._ends(v, source, destination)
            edges = v.edges(self.spark)
            if not self.multigraph and not edges.filter((F.col("src") == source) & (F.col("dst") == destination)).isEmpty():
                raise EdgeAlreadyExists((source, destination))
            self._check_degree(v, source, "src", 1)
            self._check_degree(v, destination, "dst", 1)
            edge_id = found[source]["next_edge_id"] if self.multigraph else None
            if edge_id is not None and edge_id >= EDGE_ID_END:
                raise EdgeIdExhausted(source)
            row = self.spark.createDataFrame([(source, destination, relation, flags, edge_id)], "src long, dst long, relation int, flags int, edge_id long")
            added = {"edges": row}
            if self.multigraph:
                added["counters"] = self.spark.createDataFrame([(source, edge_id + 1)], "id long, next_edge_id long")
            self._store.publish(v, added)
            return edge_id or 0

    def _check_degree(self, v: Version, node: int, side: str, more: int) -> None:
        limit = self.options.degree_limit
        if limit is None:
            return
        seen = relops.visible(v.nodes(self.spark), v.edges(self.spark).filter(F.col(side) == node))
        if seen.count() + more > limit:
            raise DegreeLimitReached(node)

    def add_edges(self, source: int, batch: Iterable[EdgeInput | tuple]) -> int:
        """Add all edges of a batch or none. An empty batch is 0, whatever the source."""
        rows = [e if isinstance(e, EdgeInput) else EdgeInput(*e) for e in batch]
        if not rows:
            return 0
        df = self.spark.createDataFrame([(source, e.destination, e.relation, e.flags, i) for i, e in enumerate(rows)],
                                        "src long, dst long, relation int, flags int, ord long")
        return self.add_edges_df(df)

    def add_edges_df(self, batch: DataFrame) -> int:
        """Add the edges (src, dst, relation, flags, ord) of a DataFrame, from any sources, all or none.

        Edge ids follow ``ord`` within each source. Errors in order: ends that do not exist, removed sources, edges
        that exist already or twice in the batch (simple mode), removed destinations, degree limits, edge ids.
        """
        with self._store.writing() as v:
            n, added = self._checked(v, batch)
            if n:
                self._store.publish(v, added)
            return n

    def _checked(self, v: Version, batch: DataFrame) -> tuple[int, dict[str, DataFrame]]:
        """How many edges a batch has, and its segments."""
        nodes, edges = v.nodes(self.spark), v.edges(self.spark)
        batch = storage.written(batch.select(
            F.col("src").cast("long"), F.col("dst").cast("long"), F.col("relation").cast("int"), F.col("flags").cast("int"), F.col("ord").cast("long")),
            storage.new_folder(self.spark, "batch"))
        bad = self._ends_of(nodes, batch)
        if not bad["n"]:
            return 0, {}
        if bad["unknown"] or bad["dead_source"]:
            raise InvalidNode
        if not self.multigraph:
            known = edges.join(batch.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select("src", "dst")
            if not batch.select("src", "dst").unionByName(known).groupBy("src", "dst").count().filter("count > 1").isEmpty():
                raise EdgeAlreadyExists
        if bad["dead_destination"]:
            raise InvalidNode
        if (limit := self.options.degree_limit) is not None:
            seen = relops.visible(nodes, edges).select("src", "dst").unionByName(batch.select("src", "dst"))
            for side in ("src", "dst"):
                touched = batch.select(side).distinct()
                if not seen.join(touched, side, "left_semi").groupBy(side).count().filter(F.col("count") > limit).isEmpty():
                    raise DegreeLimitReached
        if not self.multigraph:
            return bad["n"], {"edges": batch.withColumn("edge_id", F.lit(None).cast("long"))}
        after = nodes.select(F.col("id").alias("src"), "next_edge_id").join(batch.select("src").distinct(), "src", "left_semi")
        numbered = relops.number_edges(batch, "ord", after=after)
        high = relops.counters(numbered)
        if not high.filter(F.col("next_edge_id") > EDGE_ID_END).isEmpty():
            raise EdgeIdExhausted
        return bad["n"], {"edges": numbered, "counters": high}

    @staticmethod
    def _ends_of(nodes: DataFrame, pairs: DataFrame):
        """One row: how many (src, dst) there are, and how many have an unknown end, a removed source or a removed destination."""
        for side in ("src", "dst"):
            pairs = pairs.join(nodes.select(F.col("id").alias(side), F.col("removed").alias(f"{side}_removed")), side, "left")
        return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("src_removed").isNull() | F.col("dst_removed").isNull()).alias("unknown"),
                         F.count_if("src_removed").alias("dead_source"), F.count_if("dst_removed").alias("dead_destination")).first()

    def apply(self, adds: DataFrame, cuts: DataFrame, gone: DataFrame, stream: str, epoch: int) -> bool:
        """Add edges (src, dst, relation, flags, ord), then remove edges (src, dst), then nodes (id): all or nothing, as one version.

        The version names the stream's epoch; one that was applied before changes nothing and gives False. Edges to
        remove that do not exist are passed over, as ``remove_edge`` does; their ends must be live.
        """
        with self._store.writing() as v:
            if epoch <= v.epochs.get(stream, -1):
                return False
            nodes = v.nodes(self.spark)
            _, added = self._checked(v, adds)
            cuts = storage.written(cuts.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct(), storage.new_folder(self.spark, "cuts"))
            bad = self._ends_of(nodes, cuts)
            gone = storage.written(gone.select(F.col("id").cast("long").alias("id")).distinct(), storage.new_folder(self.spark, "gone"))
            n = gone.count()
            if bad["unknown"] or bad["dead_source"] or bad["dead_destination"] or n and gone.join(relops.live(nodes), "id", "left_semi").count() != n:
                raise InvalidNode
            later = {}
            if bad["n"]:
                later["deleted"] = cuts.withColumn("edge_id", F.lit(None).cast("long"))
            if n:
                edges = v.edges(self.spark)
                edges = edges.unionByName(added["edges"].select(edges.columns)) if added else edges
                dead = self._dead(self._touching(edges, gone), relops.removed(nodes).unionByName(gone))
                later["removed"], later["deleted"] = gone, later["deleted"].unionByName(dead) if later else dead
            self._store.publish(v, *(x for x in (added, later) if x), removed_count=v.removed_count + n, epochs=v.epochs | {stream: epoch})
            return True

    def epoch(self, stream: str) -> int:
        """The last epoch of a stream that was applied, or -1."""
        return self._store.head.epochs.get(stream, -1)

    def remove_edge(self, source: int, destination: int) -> bool:
        """Remove the edge, in multigraphs all parallel ones; False if there is none."""
        return self._cut(source, destination, None)

    def remove_edge_with_id(self, source: int, destination: int, edge_id: int) -> bool:
        if not self.multigraph:
            raise UnsupportedOperation("edge ids exist in multigraphs only")
        return self._cut(source, destination, edge_id)

    def _cut(self, source: int, destination: int, edge_id: int | None) -> bool:
        with self._store.writing() as v:
            self._ends(v, source, destination)
            hit = (F.col("src") == source) & (F.col("dst") == destination)
            if edge_id is not None:
                hit &= F.col("edge_id") == edge_id
            if v.edges(self.spark).filter(hit).isEmpty():
                return False
            row = self.spark.createDataFrame([(source, destination, edge_id)], "src long, dst long, edge_id long")
            self._store.publish(v, {"deleted": row})
            return True

    # -- maintenance -----------------------------------------------------------

    def debt(self) -> DataFrame:
        v = self._store.head
        return relops.debt(v.nodes(self.spark), v.edges(self.spark))

    def debt_stats(self) -> DebtStats:
        r = relops.debt_stats(self.nodes, self.edges).first().asDict()
        return DebtStats(**{k: r[k] for k in DebtStats._fields})

    def _tombstones(self, v: Version, near: DataFrame, ids: DataFrame) -> DataFrame:
        """Deletions of the edges among ``near`` between the nodes of ``ids`` and removed ones."""
        gone, found = relops.removed(v.nodes(self.spark)), []
        for own, other in (("src", "dst"), ("dst", "src")):
            found.append(near.join(ids.withColumnRenamed("id", own), own, "left_semi").join(gone.withColumnRenamed("id", other), other, "left_semi").select("src", "dst"))
        return found[0].unionByName(found[1]).distinct().withColumn("edge_id", F.lit(None).cast("long"))

    def repair_node(self, node: int) -> RepairNodeSummary:
        with self._store.writing() as v:
            self._ensure_live(v, node)
            own = v.edges(self.spark).filter((F.col("src") == node) | (F.col("dst") == node))
            flag = relops.debt(v.nodes(self.spark), own).filter(F.col("id") == node).first()
            if flag is None:
                return RepairNodeSummary()
            self._store.publish(v, {"deleted": self._tombstones(v, own, self.spark.range(node, node + 1))})
            fwd, rev = flag["needs_fwd"], flag["needs_rev"]
            return RepairNodeSummary(repaired_fwd=fwd, repaired_rev=rev, had_flagged_debt_fwd=fwd, had_flagged_debt_rev=rev)

    def repair_budgeted(self, max_nodes: int) -> int:
        """Repair the ``max_nodes`` smallest ids that have debt; returns how many there were."""
        with self._store.writing() as v:
            if max_nodes <= 0:
                return 0
            picked = storage.written(relops.repair_pick(v.nodes(self.spark), v.edges(self.spark), max_nodes), storage.new_folder(self.spark, "pick"))
            n = picked.count()
            if n:
                self._store.publish(v, {"deleted": self._tombstones(v, v.edges(self.spark), picked)})
            return n

    def repair_until_none(self, max_nodes: int) -> int:
        """Do what calls of ``repair_budgeted(max_nodes)`` until nothing is left do, as one version; returns how many would find work.

        A node's repair deletes only edges between it and removed nodes, so no call depends on those before, and the
        deletions of all are found at once: the jobs do not grow in number with the nodes.
        """
        with self._store.writing() as v:
            if max_nodes <= 0:
                return 0
            edges = v.edges(self.spark)
            owing = storage.written(relops.debt(v.nodes(self.spark), edges).select("id"), storage.new_folder(self.spark, "owing"))
            n = owing.count()
            if n:
                self._store.publish(v, {"deleted": self._tombstones(v, edges, owing)})
            return -(-n // max_nodes)

    def flush_repairs(self) -> RepairFlushSummary:
        """Repair all nodes by rewriting the graph's segments into one for each table."""
        with self._store.writing() as v:
            if not v.node_count:
                return RepairFlushSummary(0, 0, 0, 0, False)
            nodes, edges = v.nodes(self.spark), v.edges(self.spark)
            n = relops.debt(nodes, edges).count()
            if n:
                self._store.replace_head(self._store.compacted(v, relops.visible(nodes, edges)))
            return RepairFlushSummary(n, 1, 0, 0, False)

    def reclaim_retired(self) -> None:
        """Delete files that neither the head nor an open snapshot or session needs."""
        self._store.reclaim()

    def storage_stats(self) -> StorageStats:
        v = self._store.head
        files, total = storage.size(self.spark, self._store.folder)
        return StorageStats(v.number, sum(map(len, v.files.values())), files, total)

    # -- validation ------------------------------------------------------------

    def violations(self) -> DataFrame:
        v = self._store.head
        return validate.violations(v.nodes(self.spark), v.edges(self.spark), self.multigraph)

    def validate(self) -> None:
        self._store.check_open()
        found = self.violations().limit(1).collect()
        if found:
            raise CorruptGraph(Violation(*found[0]))

    def debug_validate(self, context: Context | None = None, limit: int | None = None) -> list[Violation]:
        """All violations, or up to ``limit``. Use ``violations`` where they may be too many for the driver."""
        self._store.check_open()
        (context or Context()).check()
        found = self.violations()
        return [Violation(*r) for r in (found if limit is None else found.limit(limit)).collect()]

    # -- end -------------------------------------------------------------------

    def deinit_checked(self) -> None:
        """Close the graph and delete its files; GraphBusy while snapshots, sessions or a writer are open."""
        self._store.close()

    def deinit(self) -> None:
        """Close the graph; RuntimeError where ``deinit_checked`` would refuse."""
        from sparkquiver.errors import GraphBusy

        try:
            self._store.close()
        except GraphBusy as e:
            raise RuntimeError("the graph is in use") from e

    # -- files -----------------------------------------------------------------

    def save(self, path: str) -> None:
        """Write the head version's tables under ``path``."""
        self.nodes.write.parquet(f"{path}/nodes")
        self.edges.repartitionByRange("src").sortWithinPartitions("src", "dst", "edge_id").write.parquet(f"{path}/edges")

    @staticmethod
    def adopt(spark: SparkSession, nodes: DataFrame, edges: DataFrame, options: GraphOptions | None = None) -> Graph:
        """A graph of given tables (``NODE_SCHEMA``, ``EDGE_SCHEMA``), as they are; ``validate`` tells whether they fit."""
        g = Graph(spark, options)
        store = g._store
        files = dict(store.head.files)
        files["nodes"] = (store.segment("nodes", nodes, 1),)
        files["edges"] = (store.segment("edges", edges.repartitionByRange("src").sortWithinPartitions("src", "dst", "edge_id"), 1),)
        files["removed"] = (store.segment("removed", nodes.filter("removed"), 1),)
        if g.multigraph:
            files["counters"] = (store.segment("counters", nodes.filter("next_edge_id > 1"), 1),)
        counts = nodes.agg(F.count("*").alias("n"), F.count_if("removed").alias("gone"), F.max("id").alias("high")).first()
        store.replace_head(replace(store.head, number=1, files=files, node_count=counts["n"], removed_count=counts["gone"],
                                   next_id=0 if counts["high"] is None else counts["high"] + 1))
        return g

    @staticmethod
    def load(spark: SparkSession, path: str, options: GraphOptions | None = None) -> Graph:
        """The graph that ``save`` wrote."""
        return Graph.adopt(spark, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), options)
