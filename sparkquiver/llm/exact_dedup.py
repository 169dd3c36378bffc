"""Exact duplicates by deterministic block naming.

Each text without white space is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and
numbered; then distinct pairs of adjacent names are sorted and numbered, level by level, until every document has
one name. Equal names at the same level mean equal texts: names are ranks among distinct values, so there is
nothing to collide. A hash serves only to spread rows and to shorten comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store

#: Bytes of a block. Most texts are one block; a text of n blocks takes ceil(log2 n) levels.
BLOCK_BYTES = 4096
#: Name spaces of a level: names are ranks within one, so each is sorted by its own task.
NAME_SPACES = 1 << 16
#: Keys that are named apart, the most frequent ones, if they have so many rows at least.
FREQUENT, FREQUENT_ROWS = 5000, 64

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _named(rows: DataFrame, key: str, store: Store) -> DataFrame:
    """``rows`` with ``name``, an integer that is equal for equal ``key`` (never null) and for no other.

    Keys are shuffled once and ranked within name spaces. The most frequent keys stay out of that: they are found
    by counts of their hashes, combined before the shuffle, and their few distinct values are ranked and broadcast.
    Any other key holds at most 1 / FREQUENT of all rows.
    """
    rows = rows.withColumn("spread", F.xxhash64(key))
    frequent = store.put(rows.groupBy("spread").count().filter(F.col("count") >= FREQUENT_ROWS)
                         .orderBy(F.desc("count"), "spread").limit(FREQUENT).select("spread"))
    if frequent.isEmpty():
        return _ranked(rows, key)
    names = frequent_names(rows.join(F.broadcast(frequent), "spread", "left_semi"), key)
    apart = rows.join(F.broadcast(frequent), "spread", "left_semi").join(F.broadcast(store.put(names)), ["spread", key]).drop("spread", key)
    return _ranked(rows.join(F.broadcast(frequent), "spread", "left_anti"), key).unionByName(apart)


def frequent_names(rows: DataFrame, key: str) -> DataFrame:
    """Negative names of the distinct keys of ``rows``, of which there are about FREQUENT."""
    distinct = rows.select("spread", key).distinct()
    return distinct.select("spread", key, (-F.row_number().over(Window.orderBy("spread", key))).cast("long").alias("name"))


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    rank = F.dense_rank().over(Window.partitionBy("space").orderBy("spread", key))
    spaced = rows.withColumn("space", F.pmod("spread", F.lit(NAME_SPACES)))
    return spaced.withColumn("name", F.col("space") * F.lit(1 << 40) + rank).drop("space", "spread", key)


def _gathered(rows: DataFrame) -> DataFrame:
    """One row per document: its names in order. A group is one document's blocks."""
    return rows.groupBy("row").agg(
        F.max("info").alias("info"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
    )


def name_documents(docs: DataFrame, store: Store, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(info(id, code_points, carry, sha), row, level, name): equal (level, name) means equal texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = (
        docs.select(F.col(id_col).alias("id"), F.struct(F.lit(0).alias("none"), *carry).alias("carry"), F.length(text).cast("long").alias("code_points"),
                    F.encode(normalised(F.col(text_col)), "UTF-8").alias("norm"))
        .select("id", "code_points", "carry", "norm", F.monotonically_increasing_id().alias("row"))
        .select("row", "id", "code_points", "carry", "norm",
                F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("norm") / BLOCK_BYTES).cast("int") - 1))).alias("pos"))
        .select("row", "pos",
                F.when(F.col("pos") == 0, F.struct("id", "code_points", "carry", F.sha2("norm", 256).alias("sha"))).alias("info"),
                F.substring("norm", F.col("pos") * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)).alias("block"))
    )
    open_ = store.put(_gathered(_named(cut, "block", store)))
    done, level = [], 0
    while True:
        done.append(open_.filter(F.size("names") == 1).select("row", "info", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        longer = open_.filter(F.size("names") > 1)
        if longer.isEmpty():
            break
        half = F.ceil(F.size("names") / 2).cast("int")
        pairs = (
            longer.select("row", "info", "names", F.explode(F.sequence(F.lit(0), half - 1)).alias("pos"))
            .select("row", "pos", F.when(F.col("pos") == 0, F.col("info")).alias("info"),
                    # names are never 0, which stands for "no right neighbour"
                    F.struct(F.element_at("names", 2 * F.col("pos") + 1).alias("a"),
                             F.coalesce(F.get("names", 2 * F.col("pos") + 1), F.lit(0)).alias("b")).alias("pair"))
        )
        open_, level = store.put(_gathered(_named(pairs, "pair", store))), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256) and the columns of ``carry``.

    Texts are equal when they are identical without white space (``[\\x20\\x09-\\x0D]``). Of equal texts the row
    with the most code points in its original text stays, then the one with the smallest id (a null id comes
    last), then the first read: of rows repeated in full exactly one stays. A null text counts as empty; all
    empty texts are one group. An empty table gives an empty result. Other columns are not read. ``docs`` is read
    more than once and must give the same rows in the same partitions each time, as files do.
    """
    store = Store(docs.sparkSession)
    named = store.put(name_documents(docs, store, id_col, text_col, carry))
    order = F.struct((-F.col("info.code_points")).alias("shorter"), F.col("info.id").isNull().alias("no_id"),
                     F.col("info.id").alias("id"), F.col("row").alias("row"))
    groups = store.put(named.groupBy("level", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")))
    return named.join(groups, ["level", "name"]).select(
        F.col("info.id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("info.sha").alias("text_sha256"), *(F.col(f"info.carry.{c}").alias(c) for c in carry))
