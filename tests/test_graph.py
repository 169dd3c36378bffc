"""Contracts of the graph's calls."""

import pytest
from pyspark.sql import functions as F

from sparkquiver import errors
from sparkquiver.builder import GraphBuilder
from sparkquiver.graph import Graph
from sparkquiver.operators.algorithms import CancelToken, Context
from sparkquiver.schema import EdgeInput, GraphOptions

MULTI = GraphOptions(multigraph=True)


def build(spark, n, edges, options=None):
    b = GraphBuilder(spark, options)
    b.add_nodes(n)
    for e in edges:
        b.add_edge(*e)
    return b.freeze()


def test_empty_graph(spark):
    g = Graph(spark)
    assert (g.node_count(), g.edge_count(), g.has_node(0)) == (0, 0, False)
    with g.snapshot() as s:
        assert s.has_cycle() is False
        with pytest.raises(errors.InvalidNode):
            s.bfs(0)
    assert g.flush_repairs().pass_count == 0
    assert g.debt_stats().live_nodes == 0
    g.validate()
    g.deinit_checked()
    assert g.node_count() == 0 and g.edge_count() == 0
    with pytest.raises(errors.GraphBusy):
        g.add_node()


def test_single_mutations(spark):
    g = Graph(spark)
    assert [g.add_node(), g.add_nodes(3), g.node_count()] == [0, 1, 4]
    g.add_edge(0, 1, 5, 6)
    g.add_edge(0, 0)
    with pytest.raises(errors.EdgeAlreadyExists):
        g.add_edge(0, 1, 9, 9)  # the relation is no part of the key
    for bad in ((0, 9), (9, 0)):
        with pytest.raises(errors.InvalidNode):
            g.add_edge(*bad)
    with pytest.raises(errors.UnsupportedOperation):
        g.add_edge_with_id(0, 2)
    with pytest.raises(ValueError):
        g.add_edge(0, 2, 1 << 16)
    assert g.edge_count() == 2
    with g.read_session() as s:
        assert (s.out_degree(0), s.in_degree(0), s.neighbors(0).materialize()) == (2, 1, [0, 1])
    assert g.remove_edge(0, 1) is True and g.remove_edge(0, 1) is False
    g.add_edge(0, 1)
    assert g.edge_count() == 2
    g.validate()


def test_batches_are_all_or_nothing(spark):
    g = Graph(spark)
    g.add_nodes(3)
    assert g.add_edges(99, []) == 0
    g.add_edge(0, 1)
    for batch, error in (([EdgeInput(2), EdgeInput(1)], errors.EdgeAlreadyExists), ([EdgeInput(2, 1), EdgeInput(2, 2)], errors.EdgeAlreadyExists), ([EdgeInput(2), EdgeInput(7)], errors.InvalidNode)):
        with pytest.raises(error):
            g.add_edges(0, batch)
        assert g.edge_count() == 1
    assert g.add_edges(0, [EdgeInput(2), EdgeInput(0)]) == 2
    with g.snapshot() as s:
        assert s.neighbors_materialized(0) == [0, 1, 2]


def test_multigraph_ids_and_metadata(spark):
    g = build(spark, 3, [(0, 2), (0, 1)], MULTI)
    with g.snapshot() as s:
        assert [(e.edge_id, e.destination) for e in s.out_edges(0)] == [(1, 1), (2, 2)]  # numbered in sorted order
    assert g.add_edge_with_id(0, 1, 7, 0x11) == 3
    assert g.remove_edge_with_id(0, 1, 3) and not g.remove_edge_with_id(0, 1, 3)
    assert g.add_edge_with_id(0, 1, 9, 0x22) == 4  # ids are not used again
    assert g.add_edges(0, [(2, 1), (1, 2)]) == 2
    with g.snapshot() as s:
        assert [tuple(e) for e in s.out_edges(0)] == [(1, 1, 0, 0), (4, 1, 9, 0x22), (6, 1, 2, 0), (2, 2, 0, 0), (5, 2, 1, 0)]
        assert s.neighbors_materialized(0) == [1, 1, 1, 2, 2]
    assert g.remove_edge(0, 1) and g.edge_count() == 2  # all parallel edges
    g.validate()


def test_out_edges_need_a_multigraph(spark):
    g = build(spark, 1, [])
    with g.snapshot() as s, pytest.raises(errors.UnsupportedOperation):
        s.out_edges(0)


def test_remove_node_and_repair(spark):
    g = build(spark, 4, [(1, 0), (0, 0), (0, 1), (2, 1), (0, 3)])
    assert tuple(g.remove_node(0)) == (4, 2, True)
    assert (g.node_count(), g.edge_count(), g.has_node(0)) == (4, 1, False)
    with pytest.raises(errors.InvalidNode):
        g.remove_node(0)
    with pytest.raises(errors.InvalidNode):
        g.remove_edge(0, 1)
    s = g.debt_stats()
    assert (s.live_nodes, s.removed_nodes, s.nodes_with_repair_fwd, s.nodes_with_repair_rev) == (3, 1, 1, 2)
    assert g.edges.count() == 4  # the self-loop of the removed node is gone at once
    r = g.repair_node(1)
    assert r.repaired_fwd and r.repaired_rev and not r.preventive_fwd
    assert not any(g.repair_node(1))
    assert g.repair_budgeted(0) == 0 and g.repair_budgeted(5) == 1 and g.repair_budgeted(5) == 0
    assert g.edges.count() == 1
    assert g.add_node() == 4  # ids are not used again
    g.remove_node(2)
    assert tuple(g.flush_repairs()) == (1, 1, 0, 0, False)
    assert g.edge_count() == 0 and g.edges.count() == 0
    g.validate()


def test_removed_at_both_ends(spark):
    g = build(spark, 3, [(0, 1), (2, 1)])
    g.remove_node(0)
    g.remove_node(1)
    with g.snapshot() as s:
        assert (g.edge_count(), s.out_degree(2)) == (0, 0)
    g.validate()


def test_snapshots_and_sessions(spark):
    g = build(spark, 3, [(0, 1), (1, 2)])
    snapshot, session = g.snapshot(), g.read_session()
    g.add_edge(2, 0)
    assert snapshot.has_cycle() is False and snapshot.neighbors(2).materialize() == []
    assert session.neighbors(2).materialize() == [0]
    with g.snapshot() as new:
        assert new.has_cycle() is True
    with pytest.raises(errors.GraphBusy):
        g.deinit_checked()
    with pytest.raises(RuntimeError):
        g.deinit()
    g.reclaim_retired()
    assert snapshot.in_degree(2) == 1
    snapshot.deinit()
    snapshot.deinit()
    session.deinit()
    g.deinit_checked()


def test_iterators(spark):
    g = build(spark, 3, [(0, 2), (0, 1)])
    with g.snapshot() as s:
        it = s.neighbors(0)
        assert (it.next(), it.materialize(), it.next()) == (1, [2], None)
        it = s.neighbors(0)
        it.deinit()
        assert it.next() is None
        with pytest.raises(errors.InvalidNode):
            s.neighbors(5)


def test_one_writer(spark):
    g = Graph(spark)
    with g._store.writing(), pytest.raises(errors.ConcurrentMutation):
        g.add_node()
    assert g.add_node() == 0


def test_degree_limit(spark):
    g = Graph(spark, GraphOptions(degree_limit=2))
    g.add_nodes(4)
    g.add_edges(0, [(1,), (2,)])
    with pytest.raises(errors.DegreeLimitReached):
        g.add_edge(0, 3)
    with pytest.raises(errors.DegreeLimitReached):
        g.add_edges(0, [(3,)])


def test_builder(spark):
    b = GraphBuilder(spark)
    b.add_nodes(3)
    with pytest.raises(errors.InvalidNode):
        b.add_edge(0, 5)
    b.add_edge(0, 1)
    with pytest.raises(errors.EdgeAlreadyExists):
        b.add_edge(0, 1)
    b.add_edges_df(spark.createDataFrame([(0, 1, 0, 0, 9)], "src long, dst long, relation int, flags int, ord long"))
    with pytest.raises(errors.EdgeAlreadyExists):
        b.freeze()
    b._frames.clear()
    g = b.freeze()  # a failed freeze leaves the builder usable
    assert (g.node_count(), g.edge_count()) == (3, 1)
    with pytest.raises(errors.UnsupportedOperation):
        b.add_node()
    assert GraphBuilder(spark).freeze().node_count() == 0


def test_traversal_fixtures(spark):
    g = build(spark, 5, [(0, 1), (0, 2), (1, 3), (2, 4)])
    with g.snapshot() as s:
        assert (s.bfs(0), s.dfs(0), s.bfs(4)) == ([0, 1, 2, 3, 4], [0, 1, 3, 2, 4], [4])
        assert s.has_cycle() is False
        token = CancelToken()
        assert s.bfs(0, Context(token))
        token.cancel()
        for call in (s.bfs, s.dfs):
            with pytest.raises(errors.Cancelled):
                call(0, Context(token))
        with pytest.raises(errors.Cancelled):
            s.has_cycle(Context(token))
        assert s.bfs(0) == [0, 1, 2, 3, 4]
    g.add_edge(4, 4)
    with g.snapshot() as s:
        assert s.has_cycle() is True
    g.remove_node(4)
    with g.snapshot() as s:
        assert s.has_cycle() is False and s.bfs(0) == [0, 1, 2, 3]


def test_compaction_and_files(spark, tmp_path):
    from sparkquiver.plans import versions

    g = Graph(spark)
    g.add_nodes(3)
    most, versions.MOST_SEGMENTS = versions.MOST_SEGMENTS, 2
    try:
        for e in ((0, 1), (1, 2), (2, 0), (0, 2)):
            g.add_edge(*e)
    finally:
        versions.MOST_SEGMENTS = most
    assert g.edge_count() == 4
    g.reclaim_retired()
    assert g.edge_count() == 4 and g.storage_stats().files > 0
    g.remove_node(1)
    g.save(str(tmp_path / "g"))
    h = Graph.load(spark, str(tmp_path / "g"))
    assert (h.node_count(), h.edge_count(), h.has_node(1)) == (3, 2, False)
    assert h.add_node() == 3


def test_an_iterator_keeps_what_it_reads(spark, monkeypatch):
    from sparkquiver.plans import versions

    monkeypatch.setattr(versions, "MOST_SEGMENTS", 1)
    g = build(spark, 4, [(0, 1), (0, 2)])
    with g.read_session() as session:
        g.add_edge(0, 3)
        it = session.neighbors(0)
        frame = session.neighbors_df(0)
        g.add_edge(1, 2)  # rewrites all segments
        g.reclaim_retired()
        assert [r["id"] for r in frame.collect()] == [1, 2, 3]
    with pytest.raises(errors.GraphBusy):
        g.deinit_checked()
    assert it.materialize() == [1, 2, 3]
    dropped = g.snapshot()
    dropped.neighbors(0).next()
    dropped.deinit()
    g.deinit_checked()


def test_a_graph_outlives_its_driver(spark):
    g = build(spark, 4, [(0, 1), (1, 2)], GraphOptions(multigraph=True))
    assert g.add_edge_with_id(0, 3) == 2
    g.remove_node(2)
    again = Graph(spark, g.options, g._store.folder)
    assert (again.node_count(), again.edge_count(), again.add_edge_with_id(0, 3)) == (4, 2, 3)
    assert again._store.head.number == g._store.head.number + 1


def test_point_mutations_filter_at_the_files(spark):
    g = build(spark, 4, [(0, 1), (1, 2), (2, 3)])
    v = g._store.head
    own = v.edges(spark).filter((F.col("src") == 1) | (F.col("dst") == 1))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(src,1),EqualTo(dst,1))]" in plan
    assert g.remove_node(1).removed_visible_edges == 2
    assert g.repair_node(2).repaired_rev and g.debt().count() == 1


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    from sparkquiver.plans import storage

    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(key, default):
            return default

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session)


def test_a_hub_is_ranked_by_ranges(spark, monkeypatch):
    from sparkquiver.operators import relops

    monkeypatch.setattr(relops, "RANGE_BITS", 3)
    g = build(spark, 100, [(0, 7 * i % 100) for i in range(1, 90)] + [(1, 5)])
    for ranked, near in ((relops.neighbors(g.visible), 0), (relops.in_neighbors(g.visible), 5)):
        rows = sorted((r["ord"], r["neighbor"]) for r in ranked.collect() if r["id"] == near)
        assert [o for o, _ in rows] == list(range(len(rows))) and [n for _, n in rows] == sorted(n for _, n in rows)
        assert len(rows) == (89 if near == 0 else 2)


def test_repair_until_none_is_all_calls_at_once(spark):
    def owing():
        b = GraphBuilder(spark, GraphOptions(multigraph=True))
        b.add_nodes(12)
        for a, z in [(i, (i * 5 + k) % 12) for i in range(12) for k in (1, 1, 4)]:
            b.add_edge(a, z)
        g = b.freeze()
        g.remove_nodes_df(spark.createDataFrame([(3,), (4,), (7,)], "id long"))
        return g

    one, many = owing(), owing()
    calls = 0
    while many.repair_budgeted(1):
        calls += 1
    before = one._store.head.number
    assert calls > 2 and one.repair_until_none(0) == 0 and one.repair_until_none(1) == calls
    assert one._store.head.number == before + 1 and one.repair_until_none(1) == 0 and one.debt().isEmpty()
    rows = [sorted(tuple(r) for r in g.edges.collect()) for g in (one, many)]
    assert rows[0] == rows[1] != []
