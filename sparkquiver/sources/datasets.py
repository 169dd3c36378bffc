"""Graphs derived from the synthetic tables, as (nodes, edges) with any columns that order parallel edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PART_OFFSET, ORDER_OFFSET = 1_000_000, 10_000_000


def _nodes(ids: DataFrame) -> DataFrame:
    return ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct().select("id", F.lit(False).alias("removed"), F.lit(1).cast("long").alias("next_edge_id"))


def _edges(df: DataFrame, src, dst, relation, *order) -> DataFrame:
    return df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), relation.cast("int").alias("relation"), F.lit(0).alias("flags"), *order)


def transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An edge from each event's user to the next event's user, in order of (ts, event_id).

    Events are ordered hour by hour in separate tasks; only each hour's first event meets the others' to bridge
    the hours.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    events = events.withColumn("hour", F.date_trunc("hour", "ts"))
    within = Window.partitionBy("hour").orderBy("ts", "event_id")
    inner = events.withColumn("dst", F.lead("user_id").over(within))
    first = events.groupBy("hour").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("first"))
    bridge = first.select("hour", F.lead("first.user_id").over(Window.orderBy("hour")).alias("next_user"))
    edges = inner.join(bridge, "hour").withColumn("dst", F.coalesce("dst", "next_user")).filter(F.col("dst").isNotNull())
    kinds = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return _nodes(events.select("user_id")), _edges(edges, F.col("user_id"), F.col("dst"), kinds, "ts", "event_id")


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tree: 0, regions from 1, nations from 100, customers from 1000."""
    region, nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    zero = F.lit(0)
    edges = _edges(region, zero, F.col("r_regionkey") + 1, zero).unionByName(
        _edges(nation, F.col("n_regionkey") + 1, F.col("n_nationkey") + 100, zero)).unionByName(
        _edges(customer, F.col("c_nationkey") + 100, F.col("c_custkey") + 1000, zero))
    return _nodes(edges.select("dst").unionByName(spark.range(1).select(F.col("id").alias("dst")))), edges


def supply(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers to parts, an edge for each line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    edges = _edges(lines, F.col("l_suppkey"), F.col("l_partkey") + PART_OFFSET, F.col("l_linenumber"), "l_orderkey", "l_linenumber")
    return _nodes(edges.select(F.explode(F.array("src", "dst")).alias("id"))), edges


def orders_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey")
    edges = _edges(orders, F.col("o_custkey"), F.col("o_orderkey") + ORDER_OFFSET, F.lit(0))
    return _nodes(edges.select(F.explode(F.array("src", "dst")).alias("id"))), edges


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chains of conversation turns."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")).distinct()
    edges = t.select("id", (F.col("id") + 1).alias("next")).join(t.select(F.col("id").alias("next")), "next", "left_semi")
    return _nodes(t), _edges(edges, F.col("id"), F.col("next"), F.lit(0))
