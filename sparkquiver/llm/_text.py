"""Vectorised word and shingle hashing over the bytes of whole texts.

Texts are laid end to end in one byte array, so a batch of any mix of lengths costs a fixed number of numpy
passes. A chunk holds at most ``CHUNK_BYTES`` unless a single text is longer; memory follows that bound.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing ``A-Z``. Those separators are ASCII, so
byte runs and code-point runs agree in UTF-8. A word's hash is a polynomial over a random 64-bit table (odd
base, modulo 2^64) with a final mix; a shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 19
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Letters: ASCII letters and every byte of a multi-byte character.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[128:] = True
_CODES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64)
_CODE_OF_LOWERED = _CODES[_LOWER]
_STEP = np.random.default_rng(77).integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` positions; kept up to one chunk's size."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, CHUNK_BYTES + 1)
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.ones(size, dtype=np.uint64)
        have = 1
        while have < size:
            step = np.uint64(pow(base, have, 1 << 64))
            more = min(have, size - have)
            table[have : have + more] = table[:more] * step
            have += more
        out.append(table)
    if size == CHUNK_BYTES + 1:
        _powers[:] = out
    return out[0], out[1]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of at most ``CHUNK_BYTES`` each, or of one longer text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) + 1 > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _hashed(texts: list[bytes], of: str) -> tuple:
    glue = b"\n" if of == "lines" else b" "
    raw = np.frombuffer(glue.join(texts) + glue, dtype=np.uint8)
    inside = _LETTER[raw] if of == "letters" else raw != 10 if of == "lines" else ~SPACE[raw]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw))
    sums = np.cumsum(_CODE_OF_LOWERED[raw] * up[: len(raw)], dtype=np.uint64)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return sums, before, down[start], np.searchsorted(ends_at, start, side="right"), start, end


def range_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """The hash of the bytes ``raw[start:end]`` of each range and of its length, A-Z lowered on demand; ranges are not empty."""
    up, down = _power(len(raw))
    sums = np.cumsum((_CODE_OF_LOWERED if lower else _CODES)[raw] * up[: len(raw)], dtype=np.uint64)
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    return mix((sums[end - 1] - before) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: list[bytes], of: str = "words") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, end byte) of every word of one chunk; bytes count from the chunk's start.

    ``of``: "words" are runs of non-spaces, "letters" runs of letters, "lines" runs without a line feed.
    """
    sums, before, down, number, start, end = _hashed(texts, of)
    return mix((sums[end - 1] - before) * down), number, start, end


def stems(texts: list[bytes], lengths: tuple[int, ...] = (4, 5, 6)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text number) of every run of letters; then, for each length, of the first bytes of longer runs."""
    sums, before, down, number, start, end = _hashed(texts, "letters")
    yield mix((sums[end - 1] - before) * down), number
    for k in lengths:
        longer = end - start > k
        yield mix((sums[start[longer] + k - 1] - before[longer]) * down[longer] + np.uint64(k)), number[longer]


def runs(number: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each text's words, for ascending text numbers."""
    size = np.bincount(number, minlength=count)
    return np.cumsum(size) - size, size


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each position on; the last ``size - 1`` positions have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29))) * _STEP[k]
    return mix(total)


def shingles(hashes: np.ndarray, number: np.ndarray, count: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each of ``count`` texts.

    A text of fewer than five words has its whole sequence as its one shingle, and a text without words none.
    """
    first, size = runs(number, count)
    all_five = window_hash(hashes, SHINGLE_WORDS)
    out = []
    for f, n in zip(first.tolist(), size.tolist()):
        if n >= SHINGLE_WORDS:
            s = np.sort(all_five[f : f + n - SHINGLE_WORDS + 1])
            if len(s) > 1:
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        elif n:
            out.append(window_hash(hashes[f : f + n], n))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def document_shingles(texts: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, sorted distinct shingles of each text) chunk by chunk."""
    for a, b in chunks(texts):
        h, number, _, _ = words(texts[a:b])
        yield a, shingles(h, number, b - a)


def slices(batch, rows: int = 512):
    """Parts of an Arrow batch, so that what is made of them is not all in memory at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: What a worker, which lasts from task to task, keeps between tasks of one kind: caches by name.
HELD: dict[str, dict] = {}


def tidy(run, keeps: str = ""):
    """``run`` over batches, in a worker that drops other operators' caches before it and freed memory after it."""

    def tidied(batches):
        for name, cache in HELD.items():
            if cache and name != keeps:
                cache.clear()
                release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def as_bytes(column) -> list[bytes]:
    """UTF-8 of each text of an Arrow array of strings; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
