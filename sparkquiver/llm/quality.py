"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed batch by batch with numpy. The trees are grown on a bounded sample of
labelled rows, over histograms of binned features, and flattened into arrays of a complete binary tree each, so a
batch is scored by one vectorised step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm import _text

#: Most labelled rows that the trees are grown on, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "longest_word", "short_words", "upper", "digit", "punctuation", "non_ascii",
    "exclamation", "question", "bar", "symbols", "comma", "stop", "markup", "space", "log_lines", "bytes_per_line",
    "distinct_words", "top_word", "distinct_lines", "repeated_bigrams", "sentence_words",
)

_CLASSES: dict[str, bytes] = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "punctuation": b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
    "non_ascii": bytes(range(128, 256)), "exclamation": b"!", "question": b"?", "bar": b"|", "symbols": b"#$%&*@^~", "comma": b",",
    "stop": b".", "markup": b"<>{}[]\\/=", "space": b" \t\n\r\x0b\x0c",
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}


def _distinct(hashes: np.ndarray, number: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many distinct hashes it has, and how often its most frequent one occurs."""
    if not len(hashes):
        return np.zeros(count), np.zeros(count)
    order = np.lexsort((hashes, number))
    h, n = hashes[order], number[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(count)
    np.maximum.at(top, n[at], np.diff(np.append(at, len(h))))
    return np.bincount(n[new], minlength=count).astype(float), top


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text; all are 0 for an empty text."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float64)
    for a, b in _text.chunks(texts):
        out[a:b] = _chunk(texts[a:b])
    return out


def _chunk(texts: list[bytes]) -> np.ndarray:
    count = len(texts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=count)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    start = np.cumsum(size + 1) - size - 1
    f: dict[str, np.ndarray] = {}
    some = np.maximum(size, 1)
    for k, table in _TABLES.items():
        sums = np.concatenate(([0], np.cumsum(table[raw], dtype=np.int64)))
        f[k] = (sums[start + size] - sums[start]) / some
    h, number, w0, w1 = _text.words(texts)
    n_words = np.bincount(number, minlength=count).astype(float)
    length = (w1 - w0).astype(float)
    longest = np.zeros(count)
    np.maximum.at(longest, number, length)
    any_words = np.maximum(n_words, 1)
    distinct, top = _distinct(h, number, count)
    two, same = _text.window_hash(h, 2), number[1:] == number[:-1]
    pairs = number[1:][same] if len(number) > 1 else number[:0]
    distinct_pairs, _ = _distinct(two[same] if len(two) else two, pairs, count)
    n_pairs = np.maximum(np.bincount(pairs, minlength=count), 1)
    lines, line_of, _, _ = _text.words(texts, "lines")
    n_lines = np.bincount(line_of, minlength=count).astype(float)
    distinct_lines, _ = _distinct(lines, line_of, count)
    f |= {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n_words), "bytes_per_word": size / any_words, "longest_word": longest,
        "short_words": np.bincount(number, weights=length <= 3, minlength=count) / any_words, "log_lines": np.log1p(n_lines),
        "bytes_per_line": size / np.maximum(n_lines, 1), "distinct_words": distinct / any_words, "top_word": top / any_words,
        "distinct_lines": distinct_lines / np.maximum(n_lines, 1), "repeated_bigrams": 1 - distinct_pairs / n_pairs,
        "sentence_words": n_words / (1 + f["stop"] * size),
    }
    out = np.stack([f[k] for k in FEATURES], axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Trees:
    """Complete trees as arrays: ``feature`` and ``cut`` by inner node, ``value`` by leaf."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for the logistic loss; splits are sought over histograms of at most ``bins`` quantile bins."""
    rows, width = x.shape
    if not rows:
        return Trees(depth, 0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    place = binned + np.arange(width) * bins
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(rows, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = ((node - first) * (width * bins))[:, None] + place
            sums = [np.bincount(at.ravel(), weights=np.repeat(v, width), minlength=n * width * bins).reshape(n, width, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = sums[0][:, :, :-1], sums[1][:, :, :-1]
            g_all, h_all = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = gl**2 / (hl + ridge) + (g_all - gl) ** 2 / (h_all - hl + ridge) - g_all**2 / (h_all + ridge)
            gain = np.where((hl >= least) & (h_all - hl >= least), gain, -1.0).reshape(n, -1)
            best = gain.argmax(axis=1)
            goes = np.zeros(rows, dtype=bool)
            for k in range(n):
                if gain[k, best[k]] > 1e-6:
                    j, b = divmod(int(best[k]), bins - 1)
                    if b < len(edges[j]):
                        feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            own_cut = cut[t][node]
            goes = x[np.arange(rows), feature[t][node]] > own_cut
            node = 2 * node + 1 + goes
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        total += value[t][leaf]
    return Trees(depth, base, feature, cut, value)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in _text.slices(whole)):
        x = statistics(_text.as_bytes(b.column(1)))
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), rows], ["label", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text) of at most ``rows`` labelled ids, those with the smallest hashes; an id with several labels has its
    largest, and of several rows of an id that of the smallest hash of its text is taken."""
    ids = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
           .groupBy("id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("id"), "id").limit(rows))
    # At most ``rows`` pairs of numbers are broadcast.
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return found.join(F.broadcast(ids), "id").groupBy("id", "label").agg(least).select("label", "least.text")


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality") -> Trees:
    """Trees for ``label_col`` (0 or 1) of ``labels``, from the statistics of at most ``sample_rows`` of its rows.

    Rows with a null id or label are left out. Without any labelled text every score is 0.5.
    """
    sample = labelled_sample(docs, labels, sample_rows, id_col, text_col, label_col)
    table = sample.mapInArrow(_text.tidy(_statistics), "label int, x array<double>").toArrow()  # numbers only
    x = np.array(table.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = table.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the order in which rows arrive does not matter
    return grow(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score), the probability of label 1 from its whole text.

    A null text counts as empty; empty texts have a score as any other. Repeated rows and null ids are rows like
    others. An empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _text.slices(whole)):
            score = sent.value.score(statistics(_text.as_bytes(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["id", "score"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_text.tidy(run), f"id {kind}, score double")
            .select(F.col("id").alias(id_col), "score"))
