"""Each stage on its own input, against the operators' definitions."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkquiver.llm._store import Store
from tests.llm.test_near_dup import brute

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
ODD = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, "a short note of six words", "en", "s", 0), (9003, "a  short note of six words", "en", "s", 0),
       (9004, "same row twice", "en", "s", 0), (9004, "same row twice", "en", "s", 0), (9005, "A SHORT note of six words", "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return Store(spark).put(d.unionByName(spark.createDataFrame(ODD, d.schema)))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_exact(spark, docs):
    groups = {}
    for r in rows(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r[1] or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    out = STAGES["exact dedup"](spark, docs, SF)
    assert rows(out) == sorted(want, key=str) and out.columns == docs.columns


def test_ngram_jaccard(spark, docs):
    kept = rows(STAGES["n-gram Jaccard join"](spark, docs, SF))
    all_ = rows(docs)
    component = {}
    for doc_id, n, c, _ in brute([(r[0], r[1], 0, None) for r in all_]):
        component.setdefault((c, doc_id if n == 0 else None), []).append(doc_id)
    assert len(kept) == len(component)
    assert {r[0] for r in kept} == {c if d is None else d for c, d in component}


def test_toxicity(spark):
    sf_dir = SF.replace("0.001", "0.01")  # the smallest table has too few toxic labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame(ODD, spark.read.parquet(f"{sf_dir}/documents.parquet").schema))
    out = Store(spark).put(STAGES["toxicity"](spark, docs, sf_dir))
    assert out.columns == docs.columns
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet")
    count = lambda d, y: d.join(toxic.filter(F.col("toxic") == y), "doc_id", "left_semi").count()
    assert count(out, 1) < 0.5 * count(docs, 1) and count(out, 0) > 0.97 * count(docs, 0)
    assert out.filter("doc_id > 9000 OR doc_id IS NULL").count() == len(ODD)


def test_decontamination(spark, docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    more = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(9999).cast("long")).withColumn("text", F.concat(F.lit("so it begins "), F.lit(item), F.lit(" and ends"))))
    clean = STAGES["benchmark decontamination"](spark, more, SF)
    assert clean.filter("doc_id = 9999").count() == 0 and clean.filter("doc_id = 9001").count() == 1
    assert clean.count() > 0.8 * docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and fill.agg(F.max("n")).first()[0] <= 2048
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_clashing_columns_and_long_texts(spark, docs):
    """Columns named as those that stages use themselves pass through, and a long text stays whole."""
    names = ("id", "row", "n", "kept", "once", "first", "score", "label", "tokens", "name", "item_id", "k1", "root")
    long = " ".join(f"long{i % 997} word{i % 13}" for i in range(60_000))
    wide = docs.limit(40).unionByName(spark.createDataFrame([(8000, long, "en", "s", len(long))], docs.schema))
    wide = Store(spark).put(wide.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names))))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns
        assert out.filter("doc_id = 8000").select("text", *names).first()[:] == (long, *range(len(names)))
    pieces = corpus_pipeline.STAGES[-1][1](spark, wide, SF).filter("doc_id = 8000").agg(F.count("*").alias("n"), F.max("start").alias("s")).first()
    assert pieces["n"] > 50 and pieces["s"] == 2048 * (pieces["n"] - 1)


def test_a_run_cleans_up(spark):
    import os

    from sparkquiver.llm._store import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    corpus_pipeline.run(spark, SF).count()
    after = set(os.listdir(shared_dir(spark))) - before
    assert len(after) == 1  # that of the result
