"""Token counts with a digest cache.

The cache is a Parquet table of (tokenizer, content, n_tokens): digests of the tokenizer's version and of a text,
and the stored count. A call joins its texts' digests to the cache, encodes each distinct text that the cache
misses once, appends those counts, and joins the counts to the documents. A later call, or one that is repeated
after a failure, encodes only what is still missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquiver.llm._encode import TokenizerFile, encoder
from sparkquiver.llm._store import Store
from sparkquiver.llm._text import as_bytes, slices, tidy

CACHE_SCHEMA = T.StructType([T.StructField("content", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
                             T.StructField("tokenizer", T.StringType())])


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _counts(file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file.value, counts_only=True)
        for b in batches:
            n = [x for part in slices(b) for x in own.encode(as_bytes(part.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.binary()), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_bytes, n_tokens), both long, of the whole text.

    ``tokenizer_path``: a ``tokenizers`` .json or a ``sentencepiece`` .model file on the driver. Ids are those of
    the library without begin, end or added special tokens, without truncation or padding. ``cache_path``: a
    folder that all executors share; it is made if missing and grows by the texts that it lacked. A null text is
    counted as empty; an empty text has no tokens. Rows that are repeated or share a text are counted once and each
    get the count. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark)
    file = TokenizerFile(tokenizer_path)
    version, sent = file.version, spark.sparkContext.broadcast(file)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The content as it is counted: null is empty, in UTF-8. Nothing else may be equated without changing counts.
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))

    def cached() -> DataFrame:
        if not _exists(spark, f"{cache_path}/tokenizer={version}"):
            return spark.createDataFrame([], CACHE_SCHEMA).select("content", "n_tokens")
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens")

    # Copies meet before the shuffle, in the map-side combine, and then at one task as one row each of its inputs.
    misses = rows.groupBy("content").agg(F.first("text").alias("text")).join(cached(), "content", "left_anti")
    (misses.select("content", "text").mapInArrow(tidy(_counts(sent), keeps="encoder"), "content binary, n_tokens long")
     .withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path))
    # Calls at the same time may both have appended a text; their counts are equal.
    counts = store.put(cached().groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))
    return (rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
            .join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens"))
