"""Immutable versions of a graph as a log of Parquet segments.

A version is a list of files: node rows, removed ids, edge id counters, edge rows and edge deletions, each with the
number of the version that wrote it. A mutation writes only what it changes and makes a new list; reading merges
them. When a version has many segments they are rewritten into one, which changes nothing that can be read. The head's
list is a small file beside the segments, so another driver can open the graph where this one left it.
"""

from __future__ import annotations

import json
import threading
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquiver.errors import ConcurrentMutation, GraphBusy
from sparkquiver.plans import storage

SCHEMAS = {
    "nodes": "id long, at long",
    "removed": "id long, at long",
    "counters": "id long, next_edge_id long, at long",
    "edges": "src long, dst long, relation int, flags int, edge_id long, at long",
    "deleted": "src long, dst long, edge_id long, at long",
}
#: A version with more segments of one table is rewritten.
MOST_SEGMENTS = 24


@dataclass(frozen=True)
class Version:
    number: int
    files: dict[str, tuple[str, ...]] = field(default_factory=lambda: {k: () for k in SCHEMAS})
    #: Ids are 0..node_count-1 for graphs built node by node, else any; the count includes removed nodes.
    node_count: int = 0
    next_id: int = 0
    removed_count: int = 0
    #: The last epoch of each stream that was applied.
    epochs: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Version:
        found = json.loads(text)
        return Version(**found | {"files": {k: tuple(v) for k, v in found["files"].items()}})

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if not self.files[name]:
            return spark.createDataFrame([], SCHEMAS[name])
        return spark.read.schema(SCHEMAS[name]).parquet(*self.files[name])

    def nodes(self, spark: SparkSession) -> DataFrame:
        out = self.table(spark, "nodes").select("id")
        if self.files["removed"]:
            gone = self.table(spark, "removed").select("id").distinct().withColumn("removed", F.lit(True))
            out = out.join(gone, "id", "left").select("id", F.coalesce("removed", F.lit(False)).alias("removed"))
        else:
            out = out.withColumn("removed", F.lit(False))
        if self.files["counters"]:
            high = self.table(spark, "counters").groupBy("id").agg(F.max("next_edge_id").alias("next_edge_id"))
            return out.join(high, "id", "left").select("id", "removed", F.coalesce("next_edge_id", F.lit(1)).cast("long").alias("next_edge_id"))
        return out.withColumn("next_edge_id", F.lit(1).cast("long"))

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = self.table(spark, "edges")
        if self.files["deleted"]:
            # A deletion holds for rows of earlier versions; without an edge id it holds for all parallel edges.
            cut = self.table(spark, "deleted").select(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("edge_id").alias("e"), F.col("at").alias("when"))
            same = (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")) & (F.col("at") < F.col("when")) & (F.col("e").isNull() | (F.col("e") == F.col("edge_id")))
            rows = rows.join(cut, same, "left_anti")
        return rows.select("src", "dst", "relation", "flags", "edge_id")


_HEAD = "head-"


class VersionStore:
    """The head version, its pins and the single writer."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or storage.new_folder(spark, "graph")).rstrip("/")
        heads = [n for n in storage.names(spark, self.folder) if n.startswith(_HEAD) and not n.endswith(".part")]
        self.head = Version.from_json(storage.read_text(spark, f"{self.folder}/{heads[-1]}")) if heads else Version(0)
        self.closed = False
        self._pins: dict[int, tuple[Version, int]] = {}
        self._lock, self._writer = threading.RLock(), threading.Lock()
        self._retired: set[str] = set()
        if heads:  # segments that the head does not read are left over from another driver
            used = {p.rsplit("/", 1)[-1] for paths in self.head.files.values() for p in paths}
            self._retired = {f"{self.folder}/{n}" for n in storage.names(spark, self.folder) if not n.startswith(_HEAD) and n not in used}

    @contextmanager
    def writing(self):
        """The writer's turn; anyone else who wants it meanwhile gets ConcurrentMutation."""
        self.check_open()
        if not self._writer.acquire(blocking=False):
            raise ConcurrentMutation
        try:
            yield self.head
        finally:
            self._writer.release()

    def check_open(self) -> None:
        if self.closed:
            raise GraphBusy

    def segment(self, name: str, df: DataFrame, number: int) -> str:
        """Write rows that version ``number`` adds."""
        path = f"{self.folder}/{name}-{number}-{uuid.uuid4().hex[:12]}"
        columns = SCHEMAS[name].replace(",", "").split()[::2][:-1]
        kinds = SCHEMAS[name].replace(",", "").split()[1::2]
        df.select(*(F.col(c).cast(k).alias(c) for c, k in zip(columns, kinds)), F.lit(number).cast("long").alias("at")).write.parquet(path)
        return path

    def publish(self, base: Version, *steps: dict[str, DataFrame], **changes) -> Version:
        """Write the segments of one or more steps, each of which sees those before it, and swap the head once."""
        number, files = base.number, dict(base.files)
        for added in steps:
            number += 1
            for name, df in added.items():
                files[name] = (*files[name], self.segment(name, df, number))
        new = replace(base, number=max(number, base.number + 1), files=files, **changes)
        if max(map(len, files.values())) > MOST_SEGMENTS:
            new = self.compacted(new)
        self.replace_head(new)
        return new

    def compacted(self, v: Version, edges: DataFrame | None = None) -> Version:
        """The same version in one segment for each table; ``edges`` stands for its edges if given."""
        nodes = v.nodes(self.spark)
        number = v.number + 1
        files = {k: () for k in SCHEMAS}
        files["nodes"] = (self.segment("nodes", nodes, number),)
        files["edges"] = (self.segment("edges", (edges if edges is not None else v.edges(self.spark)).repartitionByRange("src").sortWithinPartitions("src", "dst", "edge_id"), number),)
        if v.files["removed"]:
            files["removed"] = (self.segment("removed", nodes.filter("removed"), number),)
        if v.files["counters"]:
            files["counters"] = (self.segment("counters", nodes.filter("next_edge_id > 1"), number),)
        for paths in v.files.values():
            self._retired.update(paths)
        return replace(v, number=number, files=files)

    def replace_head(self, new: Version) -> None:
        """From here on ``new`` is what reads and other drivers find."""
        storage.write_text(self.spark, f"{self.folder}/{_HEAD}{new.number:012d}", new.to_json())
        with self._lock:
            old, self.head = self.head, new
        if old.number != new.number:
            storage.delete(self.spark, f"{self.folder}/{_HEAD}{old.number:012d}")

    def pin(self, v: Version | None = None) -> Version:
        with self._lock:
            self.check_open()
            v = v or self.head
            self._pins[v.number] = (v, self._pins.get(v.number, (v, 0))[1] + 1)
            return v

    def unpin(self, v: Version) -> None:
        with self._lock:
            n = self._pins[v.number][1] - 1
            if n:
                self._pins[v.number] = (v, n)
            else:
                del self._pins[v.number]

    @property
    def pinned(self) -> int:
        return sum(n for _, n in self._pins.values())

    def reclaim(self) -> int:
        """Delete segments that neither the head nor a pinned version reads."""
        with self._lock:
            used = {p for v in [self.head, *(v for v, _ in self._pins.values())] for paths in v.files.values() for p in paths}
            free = self._retired - used
            for p in free:
                storage.delete(self.spark, p)
            self._retired -= free
            return len(free)

    def close(self) -> None:
        with self._lock:
            if self._pins or not self._writer.acquire(blocking=False):
                raise GraphBusy
            self.closed = True
            self._writer.release()
            storage.delete(self.spark, self.folder)
