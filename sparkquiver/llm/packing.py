"""Best-fit packing of tokenised documents into sequences by hierarchical residual packing.

Each input partition packs its own pieces best-fit decreasing. Bins that are full, or nearly so, are final. The
others become items: a tree of rounds regroups them, each group packs the bins it gets best-fit decreasing, and
again only the bins that are not nearly full go on. Few bins are underfull after each round, so groups become
fewer until one is left, or until a round has found next to nothing to join. A bin holds at most as many pieces
as tokens, so its members travel with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm._encode import TokenizerFile, encoder
from sparkquiver.llm._store import Store
from sparkquiver.llm._text import as_bytes, slices, tidy

CAPACITY = 2048
#: A bin with at most this many free tokens is final.
NEARLY = 4
#: Bins that one task of a later round packs, on average.
GROUP_BINS = 20_000
#: A round that joins a smaller share of its bins is the last.
LEAST_GAIN = 0.005

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
_BINS = f"bin long, fill int, pieces array<struct<{_PIECE.replace(' long', ':long').replace(' int', ':int')}, ids:binary>>"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: items by falling length, each to the fullest bin that has room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by their free tokens
    some = 0  # bit f: there is a bin with f free tokens
    count = 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets


def _rows(bins: np.ndarray, offsets: np.ndarray, prefix: int, fields: dict[str, pa.Array], lengths: np.ndarray) -> pa.RecordBatch:
    """A row per bin with its pieces by offset."""
    order = np.lexsort((offsets, bins))
    number, first = np.unique(bins[order], return_index=True)
    fill = np.bincount(bins, weights=lengths).astype(np.int32)
    take = pa.array(order)
    struct = pa.StructArray.from_arrays([fields[k].take(take) for k in fields], names=list(fields))
    pieces = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array(number + prefix, pa.int64()), pa.array(fill[number]), pieces], ["bin", "fill", "pieces"])


def _local(file, capacity: int, end_id: int, keep_ids: bool):
    """Encode a partition's documents, cut them into pieces and pack those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, step = encoder(file.value, counts_only=False), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        ids, piece, start, length, crc, raw = [], [], [], [], [], []
        for b in (part for whole in batches for part in slices(whole)):
            for doc, data in zip(b.column(0).to_pylist(), own.encode(as_bytes(b.column(1)))):
                data += end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data if len(data) <= step else data[at : at + step]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    raw.append(part if keep_ids else None)
        if not ids:
            return
        lengths = np.array(length, dtype=np.int64)
        bins, offsets = best_fit(lengths, capacity)
        fields = {"doc_id": pa.array(ids, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                  "length": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()), "offset": pa.array(offsets), "ids": pa.array(raw, pa.binary())}
        out = _rows(bins, offsets, TaskContext.get().partitionId() << 32, fields, lengths)
        for at in range(0, out.num_rows, 4096):
            yield out.slice(at, 4096)

    return run


def _merge(capacity: int, level: int):
    """Pack a group's bins as items."""

    def run(key, table):
        table = table.combine_chunks().sort_by("bin")  # the order in which rows arrive does not matter
        fill = table.column("fill").to_numpy().astype(np.int64)
        bins, base = best_fit(fill, capacity)
        lists = table.column("pieces").combine_chunks()
        flat, size = lists.flatten(), lists.value_lengths().to_numpy()
        fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        offsets = fields["offset"].to_numpy() + np.repeat(base, size)
        fields["offset"] = pa.array(offsets)
        out = _rows(np.repeat(bins, size), offsets, (level << 56) + (key[0].as_py() << 32), fields, fields["length"].to_numpy())
        return pa.Table.from_batches([out])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset, ids).

    A document is its whole text's ids and then ``end_id``. One of more than ``capacity`` ids is cut into pieces
    of ``capacity``, the last one shorter; others are one piece. ``offset`` is the place in the sequence;
    sequences have no gaps. ``ids``: the piece's ids as little-endian unsigned 32-bit numbers if ``keep_ids``,
    else null. A null or empty text is one piece of ``end_id`` alone. Rows are packed each for itself, also when
    they are repeated or their id is null. An empty table gives an empty result. Other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    store = Store(spark)
    sent = spark.sparkContext.broadcast(TokenizerFile(tokenizer_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = store.put(rows.mapInArrow(tidy(_local(sent, capacity, end_id, keep_ids), keeps="encoder"), _BINS))
    nearly = min(NEARLY, capacity - 1)
    done, level = [packed.filter(F.col("fill") >= capacity - nearly)], 0
    left = packed.filter(F.col("fill") < capacity - nearly)
    n = left.count()
    while n > 1:
        level, groups = level + 1, -(-n // GROUP_BINS)
        grouped = left.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(groups)).cast("int"))
        packed = store.put(grouped.groupBy("part").applyInArrow(_merge(capacity, level), _BINS))
        after = packed.count()
        left = packed.filter(F.col("fill") < capacity - nearly)
        if groups == 1 or n - after < LEAST_GAIN * n:
            break
        done.append(packed.filter(F.col("fill") >= capacity - nearly))
        n = left.count()
    else:
        packed = left
    done.append(packed)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("bin", F.explode("pieces").alias("p")).select(
        F.col("p.doc_id").alias(id_col), "p.piece", "p.start", "p.length", "p.ids_crc32", F.col("bin").alias("sequence_id"), "p.offset", "p.ids")
