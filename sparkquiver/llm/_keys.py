"""Rows by 128 bits of their content.

Row numbers may differ when lost input partitions are read again; content does not. Rows alike in id and text have
the same key and may stand for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store

KEY = "__key"
#: So many keys at most are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def halves(id_: Column, text: Column) -> tuple[Column, Column]:
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(id_, text), F.xxhash64(F.lit(41), text, id_)


def key_of(k1: Column, k2: Column) -> Column:
    return F.concat(F.hex(k1), F.lit("-"), F.hex(k2))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the column KEY."""
    return docs.withColumn(KEY, key_of(*halves(F.col(id_col).cast("long"), F.col(text_col))))


def _side(keys: DataFrame, store: Store) -> DataFrame:
    keys = store.put(keys.select(KEY).distinct())
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def keep(docs: DataFrame, decided: DataFrame, store: Store) -> DataFrame:
    """Rows of keyed ``docs`` whose key is kept in ``decided`` (KEY, kept, once), without KEY.

    Of rows alike in id and text, of which a group may keep but one, the first stays where ``once`` holds.
    """
    summary = store.put(decided.groupBy(KEY).agg(F.max("kept").alias("kept"), F.max("once").alias("once"), F.count("*").alias("n")))
    out = docs.join(_side(summary.filter(~F.col("kept")), store), KEY, "left_anti")
    repeated = summary.filter(F.col("kept") & F.col("once") & (F.col("n") > 1))
    if not repeated.isEmpty():
        repeated = _side(repeated, store)
        one = docs.join(repeated, KEY, "left_semi").groupBy(KEY).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
        out = out.join(repeated, KEY, "left_anti").select(docs.columns).unionByName(one)
    return out.drop(KEY)
