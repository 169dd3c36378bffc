"""A corpus pipeline of five stages, each one of the operators with its decisions put into effect.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last one the columns of ``docs``. Rows
are decided on by their content, so ids that are null or repeated do no harm. Null texts count as empty ones, and an
empty table gives an empty one. Other columns pass through, whatever their names; a column ``__key`` is the only one
that ``docs`` must not have. Very long texts are read whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.llm._keys import KEY, keep, keyed
from sparkquiver.llm._store import Store, scope
from sparkquiver.llm.decontaminate import find_leaks
from sparkquiver.llm.exact_dedup import exact_dedup
from sparkquiver.llm.near_dup import near_duplicates
from sparkquiver.llm.packing import pack
from sparkquiver.llm.queries import TOXIC, held_out, tokenizer_path
from sparkquiver.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is TOXIC or more go, at that very score too; the others stay. Rows alike in text have one score."""
    rows = keyed(docs)
    scored = score_toxicity(rows, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()), carry=(KEY,))
    return keep(rows, scored.select(KEY, (F.col("score") < TOXIC).alias("kept"), F.lit(False).alias("once")), Store(spark))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays, that of the longest original text, then of the smallest id; of rows alike in
    both any one."""
    rows = keyed(docs)
    return keep(rows, exact_dedup(rows, carry=(KEY,)).select(KEY, "kept", F.lit(True).alias("once")), Store(spark))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect one stays, that of the smallest id, of several rows of it any one; a null id comes
    last. Documents without words stay."""
    found = near_duplicates(docs)
    return keep(keyed(docs), found.select(KEY, F.col("first").alias("kept"), (F.col("n_shingles") > 0).alias("once")), Store(spark))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: those with a window of similarity 0.75 or more, at that very value too."""
    rows, store = keyed(docs), Store(spark)
    leaks = find_leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY)
    return keep(rows, store.put(leaks.select(KEY, F.lit(False).alias("kept"), F.lit(False).alias("once"))), store)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of at most 2048 tokens. Which of pieces of one length goes where
    depends on the order of rows; how full sequences get does not."""
    return pack(docs, tokenizer_path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: Scores from nearest neighbours, components and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one's result written and read again."""
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before = docs
        with scope(spark):  # what a stage has written for itself goes, also if it fails
            docs = store.put(stage(spark, before, sf_dir))
        store.drop(before)
    return docs
