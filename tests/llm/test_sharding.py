"""Exact sizes, the matrix' margins and law, and uniformity."""

import zlib
from collections import Counter

import numpy as np

from sparkquiver.llm import sharding as module
from sparkquiver.llm.sharding import communication_matrix, shard, shard_sizes


def test_matrix():
    sizes = np.array([5, 0, 17, 3])
    m = communication_matrix(sizes, 4, 1)
    assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == shard_sizes(25, 4)).all()
    draws = np.array([communication_matrix(sizes, 4, s)[2, 0] for s in range(2000)])
    assert abs(draws.mean() - 17 * shard_sizes(25, 4)[0] / 25) < 0.1


def check(rows, got, shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    count = Counter(r["shard"] for r in got)
    assert [count[s] for s in range(shards)] == shard_sizes(len(rows), shards).tolist()
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))


def test_shard(spark, monkeypatch):
    rows = [(i, "text é %d" % (i % 7), 3) for i in range(200)] + [(5, None, 3), (None, "", 3), (7, "same", 3), (7, "same", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    first = shard(docs, 40, seed=1).collect()
    check(rows, first, 40)
    assert sorted(map(str, shard(docs.repartition(5), 40, seed=1).collect())) == sorted(map(str, first))
    monkeypatch.setattr(module, "PARTITION_ROWS", 16)
    monkeypatch.setattr(module, "SLICE_ROWS", 2)
    check(rows, shard(docs, 7, seed=2).collect(), 7)
    check(rows[:3], shard(docs.limit(3), 40).collect(), 40)
    assert shard(docs.limit(0), 40).count() == 0


def test_uniform(spark, monkeypatch):
    monkeypatch.setattr(module, "PARTITION_ROWS", 100)
    docs = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text")
    got = shard(docs, 4, seed=3).toPandas()
    # neighbours in the input land anywhere: expected 1/4 in the same shard, and no order within shards
    s = got.sort_values("doc_id")["shard"].to_numpy()
    assert abs((s[1:] == s[:-1]).mean() - 0.25) < 0.02
    assert abs(np.corrcoef(got["doc_id"], got["slot"])[0, 1]) < 0.05
