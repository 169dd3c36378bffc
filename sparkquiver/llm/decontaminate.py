"""Benchmark decontamination by SimHash of item-sized windows.

A benchmark item's class is the largest window length of a geometric grid that is not longer than the item. Every
window of every class's length in every document gets a 64-bit SimHash of its words, from packed running sums whose
counters are as wide as the length needs. A multi-index of four 16-bit blocks finds each fingerprint of an item
within ``RADIUS`` bits: of 11 differing bits some block has at most 2, and each block's table lists all values within
2 bits. The windows around each hit are verified by the exact weighted Jaccard similarity of word shingles with the
item; they have the item's own length, or are the whole text if that is shorter.

A similar window's fingerprint may be farther away, and a text shorter than the class has no window of its length. So
that no window is missed, an item's rarest shingles, of a little more than a quarter of its weight, are looked up as
well: a window similar enough shares one of them, and the windows around it are verified too. Items of fewer than
five words are one shingle, and equal windows have equal fingerprints.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm import _text

SIMILARITY = 0.75
RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
GRID = 1.25
#: Items whose index is sent to executors at a time; more are done in blocks, each against all documents, with the
#: weights of shingles that several of all items have.
ITEMS = 20_000

_NEAR = np.array([sum(1 << i for i in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), n)], dtype=np.int64)


def grid_length(words: int) -> int:
    """The class of an item of so many words."""
    length, step = 1, 1.0
    while True:
        step *= GRID
        if int(step) > words:
            return length
        length = int(step)


def lane_bits(length: int) -> int:
    """How wide counters of so many words are: one bit more than they need, for the comparison with half of them."""
    return 8 if length < 1 << 8 else 16 if length < 1 << 15 else 32


def _ones(bits: int) -> int:
    return sum(1 << i for i in range(0, 64, bits))


def lane_sums(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Running sums of the bits of word hashes, 64 / ``bits`` counters to a row's number; differences over as many words as a counter holds are exact."""
    per = 64 // bits
    spread = np.array([sum(((v >> i) & 1) << (bits * i) for i in range(per)) for v in range(1 << per)], dtype=np.uint64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros((bits, len(hashes) + 1), dtype=np.uint64)
    for k in range(bits):
        octet, shift = divmod(k * per, 8)
        np.cumsum(spread[(octets[:, octet] >> shift) & ((1 << per) - 1)], out=out[k, 1:])
    return out


def fingerprints(sums: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the ``length`` words from each position: a bit is set where at least half of the words set it."""
    bits, n = len(sums), sums.shape[1] - length
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    per, top = 64 // bits, bits - 1
    lift, tops = np.uint64(((1 << top) - (length + 1) // 2) * _ones(bits)), np.uint64(_ones(bits) << top)
    # Multiplied by this, the counters' top bits come together at the number's end.
    gather = np.uint64(sum(1 << ((bits - 1) * i) for i in range(1, per + 1)))
    out = np.zeros(n, dtype=np.uint64)
    x = np.empty(n, dtype=np.uint64)
    for k in range(bits):
        np.subtract(sums[k, length:], sums[k, :n], out=x)
        x += lift
        x &= tops
        x >>= np.uint64(top)
        x *= gather
        x >>= np.uint64(64 - per)
        x <<= np.uint64(per * k)
        out |= x
    return out


class HammingIndex:
    """Fingerprints by every value within two bits of each of their four blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.first, self.who = [], []
        for k in range(BLOCKS):
            own = ((prints >> np.uint64(BLOCK_BITS * k)) & np.uint64(0xFFFF)).astype(np.int64)
            value, who = (own[:, None] ^ _NEAR).ravel(), np.repeat(np.arange(len(prints)), len(_NEAR))
            order = np.argsort(value, kind="stable")
            self.first.append(np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))
            self.who.append(who[order].astype(np.int32))

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, fingerprint, distance) of all pairs at most RADIUS bits apart; a pair may come more than once."""
        found = []
        for k in range(BLOCKS):
            value = ((windows >> np.uint64(BLOCK_BITS * k)) & np.uint64(0xFFFF)).astype(np.int32)
            count = self.first[k][1:] - self.first[k][:-1]
            n = count[value]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            window = np.repeat(hit, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k][value[hit]], n)
            who = self.who[k][at]
            distance = np.bitwise_count(windows[window] ^ self.prints[who])
            near = distance <= RADIUS
            found.append((window[near], who[near], distance[near]))
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))  # type: ignore[return-value]


def shingle_counts(hashes: np.ndarray) -> Counter:
    """The multiset of five-word shingles; of fewer words, the whole sequence."""
    size = min(len(hashes), _text.SHINGLE_WORDS)
    return Counter(_text.window_hash(hashes, size).tolist()) if size else Counter()


class Benchmark:
    """Items with their word hashes, shingle weights and, by class, their fingerprints' index.

    For a block of a larger benchmark, ``total`` is the number of all items that have words, and ``often`` the shingles
    that several of all items have, with how many."""

    def __init__(self, ids: list[int], texts: list[bytes], total: int | None = None, often: dict[int, int] | None = None):
        self.ids, self.words = [], []
        for i, t in sorted(zip(ids, texts)):
            h = _text.words([t])[0]
            if len(h):
                self.ids.append(i)
                self.words.append(h)
        self.counts = [shingle_counts(h) for h in self.words]
        items_with = Counter(s for c in self.counts for s in c)
        if often is not None:
            items_with |= Counter(often)  # never less than in the block
        self.rarest = 1 + float(np.log(max(len(self.ids) if total is None else total, 1)))
        self.weight = {s: self.rarest - float(np.log(n)) for s, n in items_with.items()}
        # Distinct shingles of each item, ascending, with the weight of all their occurrences.
        self.sorted = [np.array(sorted(c), dtype=np.uint64) for c in self.counts]
        self.parts = [np.array([self.weight[x] * c[x] for x in sorted(c)]) for c in self.counts]
        by_class: dict[int, list[tuple[int, int]]] = {}
        for i, h in enumerate(self.words):
            length = grid_length(len(h))
            ends = fingerprints(lane_sums(h, lane_bits(length)), length)[[0, -1]]
            by_class.setdefault(length, []).extend((i, int(x)) for x in dict.fromkeys(ends.tolist()))
        # Every window that is similar enough shares one of these shingles with the item: the others weigh too little.
        pairs = [(s, i) for i, h in enumerate(self.words) if len(h) >= _text.SHINGLE_WORDS for s in self._prefix(i)]
        pairs.sort()
        keys = np.array([s for s, _ in pairs], dtype=np.uint64)
        self.prefix, self.prefix_first = np.unique(keys, return_index=True)
        self.prefix_first = np.append(self.prefix_first, len(keys))
        self.prefix_who = np.array([i for _, i in pairs], dtype=np.int64)
        self.prefix_maybe = np.zeros(1 << 20, dtype=bool)
        self.prefix_maybe[self.prefix >> np.uint64(44)] = True
        self.classes = {n: (np.array([i for i, _ in v]), HammingIndex(np.array([x for _, x in v], dtype=np.uint64))) for n, v in sorted(by_class.items())}

    def _prefix(self, item: int) -> list[int]:
        """The item's rarest shingles, of more than the share of its weight that a similar window may lack."""
        order = sorted(range(len(self.sorted[item])), key=lambda k: (-self.weight[int(self.sorted[item][k])], k))
        lacking, most, out = 0.0, (1 - SIMILARITY + 1e-9) * float(self.parts[item].sum()), []
        for k in order:
            out.append(int(self.sorted[item][k]))
            lacking += float(self.parts[item][k])
            if lacking > most:
                break
        return out

    def similarity(self, item: int, window: Counter) -> float:
        """Weighted Jaccard: a shingle counts the more, the fewer items have it."""
        own, both, either = self.counts[item], 0.0, 0.0
        for s, n in own.items():
            w, m = self.weight[s], window.get(s, 0)
            both += w * min(n, m)
            either += w * max(n, m)
        either += sum(self.weight.get(s, self.rarest) * m for s, m in window.items() if s not in own)
        return both / either if either else 0.0

    def may_reach(self, item: int, shingles: np.ndarray) -> bool:
        """Whether a window of a text with these shingles can be similar enough: what they share bounds it."""
        own = self.sorted[item]
        at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        hit = np.zeros(len(own), dtype=bool)
        hit[at[own[at] == shingles]] = True
        return float(self.parts[item][hit].sum()) >= (SIMILARITY - 1e-9) * float(self.parts[item].sum())

    def best_window(self, item: int, hashes: np.ndarray, near: np.ndarray) -> tuple[float, int]:
        """The most similar window of the item's length, or the whole text if that is shorter, that hold one of the places ``near``."""
        n, size = len(self.words[item]), _text.SHINGLE_WORDS
        last = max(len(hashes) - n, 0)
        if n < size or not last:
            starts = sorted({min(int(s), last) for s in near}) if n < size else [0]
        else:
            edge = np.zeros(last + 2, dtype=np.int64)
            np.add.at(edge, np.maximum(near - (n - size), 0), 1)
            np.add.at(edge, np.minimum(near, last) + 1, -1)
            inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            value = np.empty(len(inside))
            for run in np.split(np.arange(len(inside)), np.flatnonzero(np.diff(inside) != 1) + 1):
                value[run] = self._slide(item, hashes[inside[run[0]] : inside[run[-1]] + n])
            starts = inside[value >= max(value.max(), SIMILARITY) - 1e-9].tolist()
        best = (0.0, 0)
        for s in starts:
            value = self.similarity(item, shingle_counts(hashes[s : s + n]))
            if value > best[0]:
                best = (value, s)
        return best

    def _slide(self, item: int, hashes: np.ndarray) -> np.ndarray:
        """Similarity, but for rounding, of each window of the item's length: one shingle leaves and one comes."""
        shingles = _text.window_hash(hashes, _text.SHINGLE_WORDS).tolist()
        n, own = len(self.words[item]) - _text.SHINGLE_WORDS + 1, self.counts[item]
        weights = np.array([self.weight.get(s, self.rarest) for s in shingles])
        total = np.append(0.0, np.cumsum(weights))
        both, have, shared = 0.0, Counter(), np.empty(len(shingles) - n + 1)
        for k, s in enumerate(shingles):
            if s in own:
                have[s] += 1
                if have[s] <= own[s]:
                    both += weights[k]
            if k >= n and (gone := shingles[k - n]) in own:
                if have[gone] <= own[gone]:
                    both -= weights[k - n]
                have[gone] -= 1
            if k >= n - 1:
                shared[k - n + 1] = both
        return shared / (self.parts[item].sum() + total[n:] - total[: len(total) - n] - shared)

    def distance(self, item: int, window: np.ndarray) -> int:
        """Bits between fingerprints of the item's ends and the nearest ones of a window, of the class's length or the window's."""
        length = min(grid_length(len(self.words[item])), len(window))
        bits = lane_bits(length)
        ends = fingerprints(lane_sums(self.words[item], bits), length)[[0, -1]]
        return int(np.bitwise_count(fingerprints(lane_sums(window, bits), length)[:, None] ^ ends).min())

    def sharing(self, fives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of all places of shingles that are among an item's rarest."""
        place = np.flatnonzero(self.prefix_maybe[fives >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.prefix, fives[place]), max(len(self.prefix) - 1, 0))
        if len(place):
            hit = self.prefix[at] == fives[place]
            place, at = place[hit], at[hit]
        many = self.prefix_first[at + 1] - self.prefix_first[at] if len(at) else np.empty(0, dtype=np.int64)
        which = np.arange(many.sum()) + np.repeat(self.prefix_first[at] - (np.cumsum(many) - many), many)
        return np.repeat(place, many), self.prefix_who[which]

    def scan(self, hashes: np.ndarray, number: np.ndarray, count: int) -> Iterator[tuple[int, int, int, float, int]]:
        """(text, item, first word, similarity, distance) of the best verified window of each pair."""
        if not len(hashes):
            return
        first, size = _text.runs(number, count)
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
        sums = np.empty((0, 0), dtype=np.uint64)
        for length, (items, index) in self.classes.items():  # by length, so that counters only get wider
            if len(sums) != (bits := lane_bits(length)):
                sums = lane_sums(hashes, bits)
            prints = fingerprints(sums, length)
            window, who, distance = index.within(prints)
            text = number[window]
            inside = text == number[window + length - 1]
            for w, i, t, d in zip(window[inside].tolist(), items[who[inside]].tolist(), text[inside].tolist(), distance[inside].tolist()):
                seen.setdefault((t, i), []).append((w - int(first[t]), d))
        near = {pair: np.array([w for w, _ in hits]) for pair, hits in seen.items()}
        fives = _text.window_hash(hashes, _text.SHINGLE_WORDS)
        place, who = self.sharing(fives)
        inside = number[place] == number[place + _text.SHINGLE_WORDS - 1]
        place, who = place[inside], who[inside]
        order = np.lexsort((place, who, number[place]))
        place, who, text = place[order], who[order], number[place[order]]
        cut = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(who, prepend=-1))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(who)]):
            pair, around = (int(text[i]), int(who[i])), place[i:j] - first[text[i]]
            near[pair] = np.concatenate([near[pair], around]) if pair in near else around
        for (t, i), around in sorted(near.items(), key=lambda x: x[0]):
            own = hashes[first[t] : first[t] + size[t]]
            if len(self.words[i]) >= _text.SHINGLE_WORDS and not self.may_reach(i, fives[first[t] : first[t] + size[t] - _text.SHINGLE_WORDS + 1]):
                continue
            value, at = self.best_window(i, own, around)
            if value >= SIMILARITY:
                found = [d for _, d in seen.get((t, i), ())]
                yield t, self.ids[i], at, value, min(found) if found else self.distance(i, own[at : at + len(self.words[i])])


_SCHEMA = "row long, item_id long, first_word long, similarity double, distance int"
#: Smaller chunks than elsewhere: each word has eight running sums, which should stay in a core's cache.
_SCAN_BYTES = 1 << 18


def _scan(benchmark):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _text.slices(whole)):
            rows, texts, out = b.column(0).to_pylist(), _text.as_bytes(b.column(1)), []
            start, size = 0, 0
            for i, t in enumerate([*texts, b""]):
                if i == len(texts) or i > start and size + len(t) > _SCAN_BYTES:
                    h, number, _, _ = _text.words(texts[start:i])
                    out += [(rows[start + f[0]], *f[1:]) for f in benchmark.value.scan(h, number, i - start)]
                    start, size = i, 0
                size += len(t)
            if out:
                kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["row", "item_id", "first_word", "similarity", "distance"])

    return run


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item; of one with words also a row of null."""
    for b in batches:
        found: list[int | None] = []
        for t in _text.as_bytes(b.column(0)):
            if len(h := _text.words([t])[0]):
                found += [None, *np.array(list(shingle_counts(h)), dtype=np.uint64).view(np.int64).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["shingle"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per contaminated document and benchmark item: (id, item_id, first_word, similarity, distance).

    A document is contaminated by an item if a window of its whole text, as long as the item in words, or the whole
    text if that is shorter, has a weighted five-word shingle similarity of 0.75 or more with it. All such pairs are
    found. ``first_word`` is the best window's place, the first of equals, and ``distance`` the least one of the
    fingerprints within 11 bits, or where there is none that of the best window's. Items without words, or with a null id or
    text, match nothing, and neither do empty or null texts. Rows repeated in either table give rows each; items
    of one id are reported by that id. An empty table on either side gives an empty result. Ids of items must be
    integers. A very long text is searched whole; a worker's memory is some 100 times its bytes. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").alias("text")).dropna()
    parts = max(1, -(-items.count() // ITEMS))
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # The id travels as it is: no row number is needed, as each document's rows come from its own record.
    kind = rows.schema["id"].dataType.simpleString()
    schema = _SCHEMA.replace("row long", f"row {kind}")
    out, total, often = None, None, None
    if parts > 1:  # weights are those of the whole benchmark, whatever block an item is in
        count = items.select("text").mapInArrow(_text.tidy(_item_shingles), "shingle long").groupBy("shingle").count()
        several = count.filter("shingle IS NULL OR count > 1").toArrow()
        known = dict(zip(several.column("shingle").to_pylist(), several.column("count").to_pylist()))
        total = known.pop(None, 0)
        often = {s % (1 << 64): n for s, n in known.items()}
    for k in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toArrow()
        index = spark.sparkContext.broadcast(Benchmark(block.column("item_id").to_pylist(), [t.encode() for t in block.column("text").to_pylist()], total, often))
        found = rows.mapInArrow(_text.tidy(_scan(index)), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("row").alias(id_col), F.col("item_id").alias(item_col), "first_word", "similarity", "distance")
