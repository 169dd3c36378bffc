"""The distributed rounds give what the kernels give."""

import numpy as np
import pytest

from sparkquiver.errors import UnsupportedOperation
from sparkquiver.functions.kernels import Csr, FileCsr
from sparkquiver.operators import algorithms
from sparkquiver.operators.algorithms import Context


def frame(spark, edges):
    return spark.createDataFrame([(int(a), int(b)) for a, b in edges], "src long, dst long")


def test_bfs_rounds(spark):
    edges = np.random.default_rng(3).integers(0, 40, (70, 2))
    df = frame(spark, edges)
    start = int(edges[0, 0])
    local = algorithms.bfs(df, start).orderBy("pos").collect()
    assert algorithms.bfs(df, start, Context(local_edges=0)).orderBy("pos").collect() == local
    assert [r["pos"] for r in local] == list(range(len(local)))


@pytest.mark.parametrize("edges,cyclic", [([(0, 1), (1, 2), (2, 0), (5, 0)], True), ([(0, 1), (1, 2), (0, 2)], False), ([(3, 3)], True)])
def test_cycle_rounds(spark, edges, cyclic):
    assert algorithms.has_cycle(frame(spark, edges)) is cyclic
    assert algorithms.has_cycle(frame(spark, edges), Context(local_edges=0)) is cyclic


def test_dfs_refuses_what_one_task_cannot_hold(spark):
    with pytest.raises(UnsupportedOperation):
        algorithms.dfs(frame(spark, [(0, 1), (1, 2)]), 0, Context(local_edges=1))
    assert [r["id"] for r in algorithms.dfs(frame(spark, [(0, 1), (8, 9), (9, 8)]), 0, Context(local_edges=2)).orderBy("pos").collect()] == [0, 1]


def test_dfs_of_more_edges_than_memory_holds(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "LOCAL_EDGES", 5)
    edges = np.random.default_rng(5).integers(0, 60, (150, 2))
    edges = np.concatenate([edges, np.stack([np.full(90, 7), np.arange(90) + 30], 1)])  # and a hub, whose edges several tasks sort
    edges[0] = 7, 7
    df = frame(spark, edges).repartition(7)
    got = [tuple(r) for r in algorithms.dfs(df, 7).orderBy("pos").collect()]
    assert got == list(enumerate(Csr(edges[:, 0], edges[:, 1]).dfs(7).tolist()))
    assert algorithms.dfs(df, 10_000).collect() == [(0, 10_000)]


def test_file_csr_in_any_order_of_batches(monkeypatch):
    monkeypatch.setattr(FileCsr, "STEP", 3)
    rng = np.random.default_rng(6)
    edges = rng.integers(-20, 20, (200, 2))
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    start = int(edges[50, 0])
    place = np.arange(200) + np.repeat([0, 1 << 33], 100)
    with FileCsr() as graph:
        for part in rng.permutation(np.array_split(np.arange(200), 20)):
            graph.add(place[part], *edges[part].T)
        assert np.concatenate(list(graph.dfs(start))).tolist() == Csr(edges[:, 0], edges[:, 1]).dfs(start).tolist()
