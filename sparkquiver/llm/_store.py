"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts lineage and survives lost executors. The folder is ``spark.checkpoint.dir``; where that is
unset, as in tests, a temporary folder of this process is set.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows in a batch for Python workers.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkquiver-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Rows go to and from Python workers in batches that are small beside their memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_open", default=None)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Delete the tables of all stores made within, at the end or on an error: what was made of them must be written by then."""
    made: list[str] = []
    before = _open.set(made)
    try:
        yield
    finally:
        _open.reset(before)
        for root in made:
            delete(spark, root)


class Store:
    """Written tables of one operator call. They stay, as results read them, unless a ``scope`` ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self._made = 0
        if (made := _open.get()) is not None:
            made.append(self.root)
        self._paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read from its files."""
        self._made += 1
        path = f"{self.root}/{self._made}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if path := self._paths.pop(id(t), None):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
