"""One query per kind of violation; findings are rows (kind, node, dst, edge_id, expected, actual)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.operators import relops

#: All kinds by name. Those about blocks, groups and queues describe layouts that do not exist here and never occur.
LOGICAL_KINDS = (
    "degree_mismatch", "invalid_dst", "invalid_edge_id", "forward_reverse_mismatch", "forward_reverse_multiplicity_mismatch",
    "unsorted_block", "duplicate_edge_id", "edge_id_counter_regressed", "repair_debt_invalid_node", "removed_node_has_outgoing",
    "removed_node_has_reverse_residual", "removed_node_has_reverse_storage", "removed_node_marked_for_repair",
    "forward_tombstone_missing_repair_flag", "reverse_tombstone_missing_repair_flag", "edge_count_mismatch", "forward_reverse_count_mismatch",
)
PHYSICAL_KINDS = (
    "occupancy_below_threshold", "mask_bit_out_of_range", "blockgroup_chain_cycle", "blockgroup_overlap",
    "run_fragmentation_requires_repair", "grouped_layout_needs_canonicalization", "block_double_owned", "block_orphaned_in_free_list",
    "retired_block_reachable", "unreachable_forward_block", "unreachable_reverse_block", "unreachable_group", "block_count_group_mismatch",
)

_COLUMNS = ("node", "dst", "edge_id", "expected", "actual")


#: Edges of both copies that one task counts by pair.
PAIR_ROWS = 1_000_000


def _side(edges: DataFrame, n: int, m: int) -> DataFrame:
    return edges.select("src", "dst", F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"))


def _found(df: DataFrame, kind: str | Column, **columns) -> DataFrame:
    null = F.lit(None).cast("long")
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *((columns[c].cast("long") if c in columns else null).alias(c) for c in _COLUMNS))


def violations(nodes: DataFrame, edges: DataFrame, multigraph: bool, reverse: DataFrame | None = None, degrees: DataFrame | None = None,
               edge_count: int | None = None, check_counters: bool = True) -> DataFrame:
    """All logical violations of a graph's tables.

    ``reverse`` (src, dst): a second copy of the edges, if one is kept. ``degrees`` (id, out_degree, in_degree) and
    ``edge_count``: cached numbers to hold against the edges.
    """
    src, dst, eid = F.col("src"), F.col("dst"), F.col("edge_id")
    found = []
    for end in ("src", "dst"):
        lost = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti")
        found.append(_found(lost, "invalid_dst", node=src, dst=dst, edge_id=eid))
    gone = relops.removed(nodes)
    both = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found.append(_found(both, "removed_node_has_outgoing", node=src, dst=dst, edge_id=eid))
    if multigraph:
        found.append(_found(edges.filter(eid.isNull() | (eid <= 0)), "invalid_edge_id", node=src, dst=dst, edge_id=eid))
        twice = edges.filter(eid > 0).groupBy("src", "edge_id").agg(F.count("*").alias("n")).filter("n > 1")
        found.append(_found(twice, "duplicate_edge_id", node=src, edge_id=eid, expected=F.lit(1), actual=F.col("n")))
        if check_counters:
            high = edges.groupBy("src").agg(F.max("edge_id").alias("high")).join(nodes.withColumnRenamed("id", "src"), "src")
            found.append(_found(high.filter("high >= next_edge_id"), "edge_id_counter_regressed", node=src, expected=F.col("high") + 1, actual=F.col("next_edge_id")))
    else:
        found.append(_found(relops.multiplicity(edges).filter("n > 1"), "unsorted_block", node=src, dst=dst, expected=F.lit(1), actual=F.col("n")))
    seen = relops.visible(nodes, edges)
    if reverse is not None:
        both = _side(seen, 1, 0).unionByName(_side(relops.visible(nodes, reverse), 0, 1))
        sums = (F.sum("n").alias("n"), F.sum("m").alias("m"))
        totals = both.agg(*sums).filter("n <> m")
        found.append(_found(totals, "forward_reverse_count_mismatch", expected=F.col("n"), actual=F.col("m")))
        # One table of counts for both kinds. Tasks take a number of edges that is bounded, however many there are.
        parts = max(1, -(-both.count() // PAIR_ROWS))
        pairs = both.repartition(parts, "src", "dst").groupBy("src", "dst").agg(*sums).filter("n <> m")
        one = (F.col("n") == 0) | (F.col("m") == 0)
        kind = F.when(one, "forward_reverse_mismatch").otherwise("forward_reverse_multiplicity_mismatch")
        found.append(_found(pairs, kind, node=src, dst=dst, expected=F.col("n"), actual=F.col("m")))
        left = reverse.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").join(gone.withColumnRenamed("id", "src"), "src", "left_semi")
        found.append(_found(left, "removed_node_has_reverse_residual", node=dst, dst=src))
    if degrees is not None:
        for side, name in ((relops.out_degree, "out_degree"), (relops.in_degree, "in_degree")):
            real = side(nodes, seen).join(degrees.select("id", F.col(name).alias("cached")), "id", "left")
            found.append(_found(real.filter(~F.col("cached").eqNullSafe(F.col("degree"))), "degree_mismatch", node=F.col("id"), expected=F.col("degree"), actual=F.col("cached")))
    if edge_count is not None:
        n = seen.agg(F.count("*").alias("n")).filter(F.col("n") != edge_count)
        found.append(_found(n, "edge_count_mismatch", expected=F.col("n"), actual=F.lit(edge_count)))
    return reduce(DataFrame.unionByName, found)
