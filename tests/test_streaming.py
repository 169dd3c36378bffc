"""A stream of mutations, batches that come again, and batches that fail."""

import pytest

from sparkquiver import errors
from sparkquiver.graph import Graph
from sparkquiver.streaming.mutation_log import LOG_SCHEMA, MutationLog


def edges(g):
    return sorted((r["src"], r["dst"]) for r in g.visible.collect())


def test_follow(spark, tmp_path):
    g = Graph(spark)
    g.add_nodes(4)
    rows = [("add_edge", 0, 1, 0, 0, 0), ("add_edge", 1, 2, 0, 0, 1), ("add_edge", 2, 3, 0, 0, 2), ("remove_edge", 0, 1, 0, 0, 3), ("remove_node", 3, None, 0, 0, 4)]
    spark.createDataFrame(rows, LOG_SCHEMA).write.parquet(str(tmp_path / "log"))
    log = MutationLog(g)
    q = log.follow(spark.readStream.schema(LOG_SCHEMA).parquet(str(tmp_path / "log")), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert edges(g) == [(1, 2)]
    version = g._store.head.number
    log.apply(spark.createDataFrame(rows, LOG_SCHEMA), log.epoch)
    assert g._store.head.number == version


def test_a_new_log_knows_what_was_applied(spark):
    g = Graph(spark)
    g.add_nodes(2)
    batch = spark.createDataFrame([("add_edge", 0, 1, 0, 0, 0)], LOG_SCHEMA)
    MutationLog(g).apply(batch, 0)
    MutationLog(g).apply(batch, 0)
    MutationLog(Graph(spark, g.options, g._store.folder)).apply(batch, 0)  # after a restart of the driver
    assert edges(g) == [(0, 1)]
    assert (g.epoch("log"), g.epoch("other")) == (0, -1)


def test_a_batch_that_fails_leaves_nothing(spark):
    g = Graph(spark)
    g.add_nodes(3)
    bad = spark.createDataFrame([("add_edge", 0, 1, 0, 0, 0), ("remove_node", 9, None, 0, 0, 1)], LOG_SCHEMA)
    log = MutationLog(g)
    for _ in range(2):
        with pytest.raises(errors.InvalidNode):
            log.apply(bad, 0)
    assert edges(g) == [] and log.epoch == -1
    log.apply(spark.createDataFrame([("add_edge", 0, 1, 0, 0, 0), ("add_edge", 1, 2, 0, 0, 1), ("remove_node", 2, None, 0, 0, 2)], LOG_SCHEMA), 0)
    assert edges(g) == [(0, 1)]
    log.apply(spark.createDataFrame([], LOG_SCHEMA), 1)
    assert log.epoch == 1
