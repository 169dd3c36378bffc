"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to source partitions by a hash. How many rows each source partition sends to each shard is drawn
at once, as a matrix of multivariate hypergeometric counts whose margins are the partition sizes and the exact
shard sizes. Each partition is permuted locally and cut at its row of the matrix; after the exchange each shard is
permuted again. Only the matrix (source partitions x shards) is on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store

#: Rows that a source partition has on average, and the most source partitions there are.
PARTITION_ROWS = 1 << 12
MAX_PARTITIONS = 1 << 14
#: Slices of a shard that are permuted by tasks of their own, at about this many rows each.
SLICE_ROWS = 1 << 14


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart that add up to ``rows``."""
    return rows // shards + (np.arange(shards) < rows % shards)


def communication_matrix(sizes: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts of rows from each partition (row) to each shard (column), uniform among all deals."""
    rng = np.random.default_rng(seed)
    left = shard_sizes(int(sizes.sum()), shards).astype(np.int64)
    out = np.zeros((len(sizes), shards), dtype=np.int64)
    for i, n in enumerate(sizes.tolist()):
        if n:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
            left -= out[i]
    return out


def _partitions(rows: int) -> int:
    want = max(1, -(-rows // PARTITION_ROWS))
    return min(MAX_PARTITIONS, 1 << (want - 1).bit_length())


def shard(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, size, text_crc32, shard, slot); slots run from 0 without gaps in each shard.

    Shard sizes in rows differ by one at most. ``size`` is the UTF-8 bytes of the text and 16 more; a null text
    has no bytes and the checksum of the empty text. Rows alike in id, size and checksum are interchangeable, so
    ties and repeated rows give the same result in any order. Null ids are rows like others. A very long text
    counts by its size alone. An empty table gives an empty result. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    store = Store(spark)
    rows = store.put(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                                        F.crc32(F.encode(text, "UTF-8")).alias("crc")))
    n = rows.count()
    parts = _partitions(n)
    # Two keys from independent seeds: one permutes within a source partition, the other within a shard.
    keyed = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "id", "size", "crc"), F.lit(parts)).cast("int"))
    sizes = np.zeros(parts, dtype=np.int64)
    for r in keyed.groupBy("part").count().collect():  # at most MAX_PARTITIONS rows
        sizes[r["part"]] = r["count"]
    # Column j of ends: the first rank in the partition that goes beyond shard j.
    ends = np.cumsum(communication_matrix(sizes, shards, seed), axis=1)
    lines = spark.createDataFrame([(i, ",".join(map(str, x))) for i, x in enumerate(ends.tolist())], "part int, line string")
    matrix = store.put(lines.select("part", F.split("line", ",").cast("array<long>").alias("ends")))
    ranked = keyed.withColumn("rank", F.row_number().over(
        Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "id", "size", "crc"), "id", "size", "crc")) - 1)
    # Ranks of one partition are 0, 1, ...: the shard is the number of ends that are not beyond the rank.
    dealt = ranked.join(matrix, "part").select(
        "id", "size", "crc", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    slices = max(1, -(-n // (shards * SLICE_ROWS)))
    second = F.xxhash64(F.lit(seed + 2), "id", "size", "crc", "shard")
    dealt = store.put(dealt.withColumn("key", second).withColumn("slice", F.pmod(F.shiftrightunsigned("key", 32), F.lit(slices)).cast("int")))
    counts = dealt.groupBy("shard", "slice").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "slice", before.alias("start"))
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("key", "id", "size", "crc")) - 1)
    return placed.join(starts, ["shard", "slice"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("at")).alias("slot"))
