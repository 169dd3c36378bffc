"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.llm._store import Store
from sparkquiver.llm.decontaminate import find_leaks
from sparkquiver.llm.exact_dedup import exact_dedup
from sparkquiver.llm.licenses import find_licenses
from sparkquiver.llm.near_dup import near_duplicates
from sparkquiver.llm.packing import pack
from sparkquiver.llm.quality import fit_quality, score_quality
from sparkquiver.llm.secrets import find_secrets
from sparkquiver.llm.sharding import shard
from sparkquiver.llm.token_counts import count_tokens
from sparkquiver.llm.toxicity import score_toxicity

#: From this score on a document counts as toxic.
TOXIC = 0.5


def held_out() -> Column:
    """Rows that no model learns from; rows without an id have no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").filter(~held_out())
    scored = score_toxicity(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
                         F.transform("evidence", lambda e: e["id"]).alias("evidence_ids"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{Store(spark).root}/token-cache"  # a new cache, so that this call encodes whatever its documents need
    counts = count_tokens(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("random"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(_documents(spark, sf_dir), 40, seed=20240607)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(_documents(spark, sf_dir))
    return found.select("doc_id", "canonical_sha256", "text_license", F.array_join("licenses", ",").alias("licenses"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_quality(docs, _table(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_exact_dedup, op3_toxicity, op4_token_counts, op5_decontaminate, op6_secrets, op7_shard, op8_licenses, op9_quality, op10_pack)
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS shingle FROM t),
        n AS (SELECT t.doc_id, count(s.shingle) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
        SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = doc_id) AS component_id,
               (SELECT count(*) FROM link WHERE link.x = doc_id) AS n_links
        FROM n""",
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM t""",
}
