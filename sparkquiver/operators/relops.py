"""Set-at-a-time graph operators; point reads are filters over them.

An edge is visible if both its ends are live. ``clean=True`` states that no node is removed, so that the check of
ends is left out of the plan. Removed nodes are the side that is joined away: Spark broadcasts them while their
size allows and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("removed")).select("id")


def removed(nodes: DataFrame) -> DataFrame:
    return nodes.filter("removed").select("id")


def visible(nodes: DataFrame, edges: DataFrame, clean: bool = False) -> DataFrame:
    """Edges whose ends are both live."""
    if clean:
        return edges
    gone = removed(nodes)
    out = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    return out.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(edges.columns)


#: Ends within a range of 2 to this power are ranked by one task; a hub has many such ranges.
RANGE_BITS = 20


def _ordered(edges: DataFrame, near: str, far: str) -> DataFrame:
    """(id, ord, neighbor) by (far, edge_id): ranks within ranges of ``far``, after the counts of the ranges before."""
    edges = edges.select(F.col(near).alias("id"), F.col(far).alias("neighbor"), "edge_id", F.shiftright(far, RANGE_BITS).alias("range"))
    before = F.sum("count").over(Window.partitionBy("id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = edges.groupBy("id", "range").count().select("id", "range", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("id", "range").orderBy("neighbor", "edge_id")) - 1
    return edges.withColumn("rank", rank).join(starts, ["id", "range"]).select("id", (F.col("start") + F.col("rank")).cast("long").alias("ord"), "neighbor")


def neighbors(visible_edges: DataFrame) -> DataFrame:
    """(id, ord, neighbor): out-neighbours in order of destination, then edge id; parallel edges repeat."""
    return _ordered(visible_edges, "src", "dst")


def in_neighbors(visible_edges: DataFrame) -> DataFrame:
    """(id, ord, neighbor): in-neighbours in order of source."""
    return _ordered(visible_edges, "dst", "src")


def neighbors_materialized(visible_edges: DataFrame) -> DataFrame:
    """(id, neighbors array): each source's out-neighbours in ascending order."""
    return visible_edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


def in_neighbors_materialized(visible_edges: DataFrame) -> DataFrame:
    return visible_edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("neighbors"))


def out_edges(visible_edges: DataFrame) -> DataFrame:
    """(id, edge_id, dst, relation, flags) of a multigraph."""
    return visible_edges.select(F.col("src").alias("id"), "edge_id", "dst", "relation", "flags")


def _degree(nodes: DataFrame, visible_edges: DataFrame, side: str) -> DataFrame:
    counts = visible_edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    return live(nodes).join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def out_degree(nodes: DataFrame, visible_edges: DataFrame) -> DataFrame:
    """(id, degree) of every live node."""
    return _degree(nodes, visible_edges, "src")


def in_degree(nodes: DataFrame, visible_edges: DataFrame) -> DataFrame:
    return _degree(nodes, visible_edges, "dst")


def multiplicity(visible_edges: DataFrame) -> DataFrame:
    """(src, dst, n): parallel edges of each pair."""
    return visible_edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def number_edges(edges: DataFrame, *order: str, after: DataFrame | None = None) -> DataFrame:
    """Source-local edge ids from 1, or from ``after`` (src, next_edge_id), in the given order."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order)).cast("long")
    if after is None:
        return edges.withColumn("edge_id", rank)
    return (edges.withColumn("_rank", rank).join(after, "src", "left")
            .withColumn("edge_id", F.col("_rank") + F.coalesce("next_edge_id", F.lit(1)) - 1).drop("_rank", "next_edge_id"))


def counters(edges: DataFrame) -> DataFrame:
    """(id, next_edge_id) of every source."""
    return edges.groupBy(F.col("src").alias("id")).agg((F.max("edge_id") + 1).alias("next_edge_id"))


def removal_summary(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, removed_visible_edges, related_live_nodes_touched, left_repair_debt) of removing each id alone.

    A self-loop counts once; related nodes are distinct and exclude the node itself.
    """
    seen = visible(nodes, edges)
    out = seen.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("other"))
    into = seen.filter("src <> dst").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("other"))
    touched = F.count_distinct(F.when(F.col("other") != F.col("id"), F.col("other")))
    counts = out.unionByName(into).groupBy("id").agg(F.count("*").alias("n"), touched.alias("t"))
    return ids.join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("removed_visible_edges"),
        F.coalesce("t", F.lit(0)).cast("long").alias("related_live_nodes_touched"), (F.coalesce("t", F.lit(0)) > 0).alias("left_repair_debt"))


def mark_removed(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``nodes`` with the given ids removed."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return nodes.join(hit, "id", "left").select("id", (F.col("removed") | F.coalesce("_hit", F.lit(False))).alias("removed"), "next_edge_id")


def debt(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, needs_fwd, needs_rev) of live nodes that have an edge from or to a removed node."""
    gone = removed(nodes)
    fwd = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(1).alias("f"), F.lit(0).alias("r"))
    rev = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(0).alias("f"), F.lit(1).alias("r"))
    flags = fwd.unionByName(rev).groupBy("id").agg((F.max("f") == 1).alias("needs_fwd"), (F.max("r") == 1).alias("needs_rev"))
    return flags.join(gone, "id", "left_anti")


def debt_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters; queues and groups do not exist here and count 0."""
    counts = nodes.agg(F.coalesce(F.sum(F.when(~F.col("removed"), 1)), F.lit(0)).cast("long").alias("live_nodes"),
                       F.coalesce(F.sum(F.when(F.col("removed"), 1)), F.lit(0)).cast("long").alias("removed_nodes"))
    flags = debt(nodes, edges).agg(F.count_if("needs_fwd").alias("nodes_with_repair_fwd"), F.count_if("needs_rev").alias("nodes_with_repair_rev"),
                                   F.count_if("needs_fwd").alias("estimated_tombstone_fwd_nodes"))
    zero = F.lit(0).cast("long")
    # Two one-row tables side by side.
    return counts.withColumn("_one", F.lit(1)).join(flags.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumns(
        {k: zero for k in ("queued_repair_fwd", "queued_repair_rev", "grouped_fwd_nodes", "grouped_rev_nodes")})


def repair(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Edges without those between the given nodes (all if None) and removed ones."""
    gone = removed(nodes).withColumn("_gone", F.lit(True))
    if ids is None:
        return visible(nodes, edges)
    fix = ids.select("id").distinct().withColumn("_fix", F.lit(True))
    e = edges
    for side in ("src", "dst"):
        e = e.join(gone.select(F.col("id").alias(side), F.col("_gone").alias(f"_gone_{side}")), side, "left")
        e = e.join(fix.select(F.col("id").alias(side), F.col("_fix").alias(f"_fix_{side}")), side, "left")
    drop = (F.col("_fix_src").isNotNull() & F.col("_gone_dst").isNotNull()) | (F.col("_fix_dst").isNotNull() & F.col("_gone_src").isNotNull())
    return e.filter(~drop).select(edges.columns)


def repair_pick(nodes: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` smallest ids among nodes with debt."""
    return debt(nodes, edges).select("id").orderBy("id").limit(budget)
