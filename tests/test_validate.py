"""Corrupt tables and the violations that they must give."""

import pytest

from sparkquiver.graph import Graph
from sparkquiver.operators import validate
from sparkquiver.queries import QUERIES
from sparkquiver.schema import GraphOptions

NODES = "id long, removed boolean, next_edge_id long"
EDGES = "src long, dst long, relation int, flags int, edge_id long"


def kinds(spark, nodes, edges, multigraph, **more):
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    return sorted((r["kind"], r["node"]) for r in validate.violations(n, e, multigraph, **more).collect())


OK = [(0, False, 5), (1, False, 5), (2, False, 5)]


@pytest.mark.parametrize("nodes,edges,multigraph,want", [
    (OK, [(0, 1, 0, 0, 1), (0, 1, 0, 0, 2)], True, []),
    (OK, [(0, 1, 0, 0, None), (0, 1, 3, 0, None)], False, [("unsorted_block", 0)]),
    (OK, [(0, 7, 0, 0, 1)], True, [("invalid_dst", 0)]),
    (OK, [(0, 1, 0, 0, 0)], True, [("invalid_edge_id", 0)]),
    (OK, [(0, 1, 0, 0, 2), (0, 2, 0, 0, 2)], True, [("duplicate_edge_id", 0)]),
    (OK, [(0, 1, 0, 0, 5)], True, [("edge_id_counter_regressed", 0)]),
    ([(0, True, 1), (1, True, 1)], [(0, 1, 0, 0, None)], False, [("removed_node_has_outgoing", 0)]),
])
def test_kinds(spark, nodes, edges, multigraph, want):
    assert kinds(spark, nodes, edges, multigraph) == want


def test_copies_and_cached_numbers(spark):
    rev = spark.createDataFrame([(0, 1), (1, 2), (1, 2)], "src long, dst long")
    degrees = spark.createDataFrame([(0, 1, 0), (1, 9, 1), (2, 0, 1)], "id long, out_degree long, in_degree long")
    found = kinds(spark, OK, [(0, 2, 0, 0, 1), (1, 2, 0, 0, 1)], True, reverse=rev, degrees=degrees, edge_count=7)
    assert [k for k, _ in found] == sorted([
        "forward_reverse_mismatch", "forward_reverse_mismatch", "forward_reverse_multiplicity_mismatch", "forward_reverse_count_mismatch",
        "degree_mismatch", "degree_mismatch", "degree_mismatch", "edge_count_mismatch"])


def test_all_kinds_have_names():
    assert len(validate.LOGICAL_KINDS + validate.PHYSICAL_KINDS) == len(set(validate.LOGICAL_KINDS + validate.PHYSICAL_KINDS)) == 30


def test_debug_validate_lists_all(spark):
    n = 10_001  # one more than an earlier default
    nodes = spark.range(n).selectExpr("id", "false AS removed", "2L AS next_edge_id")
    edges = spark.range(n).selectExpr("id AS src", "1000000L AS dst", "0 AS relation", "0 AS flags", "1L AS edge_id")
    g = Graph.adopt(spark, nodes, edges, GraphOptions(multigraph=True))
    with g.snapshot() as s:
        assert len(g.debug_validate()) == len(s.debug_validate()) == g.violations().count() == n
        assert len(g.debug_validate(limit=3)) == len(s.debug_validate(limit=3)) == 3


def test_copies_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(validate, "PAIR_ROWS", 2)
    fwd = [(i, i + 1, 0, 0, k) for i in range(20) for k in (1, 2)]
    rev = spark.createDataFrame([(s, d) for s, d, *_ in fwd if s != 4] + [(9, 10), (19, 0)], "src long, dst long")
    nodes = [(i, False, 5) for i in range(21)]
    assert kinds(spark, nodes, fwd, True, reverse=rev) == [("forward_reverse_mismatch", 4), ("forward_reverse_mismatch", 19), ("forward_reverse_multiplicity_mismatch", 9)]
    both = kinds(spark, nodes, fwd, True, reverse=rev.filter("src <> 9"))
    assert ("forward_reverse_count_mismatch", None) in both and ("forward_reverse_mismatch", 9) in both


@pytest.mark.parametrize("name", ["violations_of_copies", "violations_of_removed"])
def test_branches_do_not_sort_the_edges_anew(spark, sf_dir, name):
    assert "Window" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
