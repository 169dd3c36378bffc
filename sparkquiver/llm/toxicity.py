"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows gives the examples. There are two views of a text, both searched exactly with a
block-max index. In the first its terms are all its words; a word that no example has counts as one of a single
document, and takes part in the norm. In the second they are the telling terms, words and beginnings of words whose
chi-squared association with the label is strong. Document frequencies are counted over all documents.

The index keeps examples that are alike in blocks. Of its most frequent terms each block has the weights and their
largest; the other terms have postings. A query's sums over postings are exact; with the largest weights they bound
what a block can reach, and only blocks whose bound reaches the k-th best cosine are computed. Distance-weighted
votes of both views are calibrated together by leave-one-out votes among the examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquiver.llm import _text
from sparkquiver.llm._store import Store

#: Most examples of each label, those with the smallest hashes of their ids, and most telling terms.
EXAMPLES = 2048
VOCABULARY = 512
#: A term is telling if so many examples have it, as well as this share of the rarer label's (else the words of one
#: group of copies look telling), and if its chi-squared statistic is that large (p < 1e-5).
LEAST_EXAMPLES, LEAST_SHARE, LEAST_CHI2 = 5, 0.02, 19.5
NEIGHBOURS = 31
#: Examples in a block, and terms whose weights are kept by block; the others have postings.
BLOCK, DENSE = 64, 512
#: Queries at a time, and blocks of each that are computed before the others' bounds are looked at.
ROWS, AHEAD = 128, 8
#: Places whose largest score stands for them in the estimate of the k-th best.
GROUP = 16
#: Postings that are added up at a time.
HITS = 1 << 18
#: Distances that count as none in votes of whole texts, so that a copy outweighs all others, and of telling terms.
COPY, TOLD = 0.001, 0.01
_EPS = 1e-5


class Vectors(NamedTuple):
    """Texts as ascending term numbers with counts: those of text i are at ``first[i]`` to ``first[i + 1]``. ``rest`` is
    the sum of the squares of 1 + log of the counts of each text's terms without a number."""

    first: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    rest: np.ndarray

    def part(self, a: int, b: int) -> Vectors:
        i, j = self.first[a], self.first[b]
        return Vectors(self.first[a : b + 1] - i, self.terms[i:j], self.counts[i:j], self.rest[a:b])

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rest)), np.diff(self.first))

    @staticmethod
    def of(text: np.ndarray, term: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> Vectors:
        """From entries in order of text and term."""
        return Vectors(np.searchsorted(text, np.arange(len(rest) + 1)), term, counts, rest)

    @staticmethod
    def joined(parts: list[Vectors]) -> Vectors:
        ends = np.cumsum([0] + [len(p.terms) for p in parts])
        return Vectors(np.concatenate([[0], *(p.first[1:] + e for p, e in zip(parts, ends))]).astype(np.int64), *(
            np.concatenate([np.empty(0, dtype=t), *(getattr(p, k).astype(t) for p in parts)]) for k, t in (("terms", np.int32), ("counts", np.int32), ("rest", float))))


def _counted(text: np.ndarray, term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with how often each occurs; terms are below ``size``."""
    key, times = np.unique(text * max(size, 1) + term, return_counts=True)
    return *np.divmod(key, max(size, 1)), times


def _found(hashes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash is in the ascending ``among``, and whether it is."""
    if not len(among):
        return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
    at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
    return at, among[at] == hashes


def views(texts: list[bytes], vocabulary: np.ndarray, telling: np.ndarray) -> Iterator[tuple[Vectors, Vectors]]:
    """Both views of texts, chunk by chunk; terms are numbers of the ascending hashes of either."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[telling >> np.uint64(48)] = True
    for a, b in _text.chunks(texts):
        parts = _text.stems(texts[a:b])
        words, number = next(parts)
        distinct, which = np.unique(words, return_inverse=True)
        text, term, times = _counted(number, which, len(distinct))
        at, hit = _found(distinct, vocabulary)
        known = hit[term]
        rest = np.bincount(text[~known], weights=(1 + np.log(times[~known])) ** 2, minlength=b - a)
        # Hashes ascend as the vocabulary does, so each text's terms do.
        whole = Vectors.of(text[known], at[term[known]], times[known], rest)
        told_text, told_term = [], []
        for h, n in ((words, number), *parts):
            some = np.flatnonzero(maybe[h >> np.uint64(48)])
            at, hit = _found(h[some], telling)
            told_text.append(n[some[hit]])
            told_term.append(at[hit])
        yield whole, Vectors.of(*_counted(np.concatenate(told_text), np.concatenate(told_term), len(telling)), np.zeros(b - a))


def all_views(texts: list[bytes], vocabulary: np.ndarray, telling: np.ndarray) -> tuple[Vectors, Vectors]:
    found = list(views(texts, vocabulary, telling))
    whole = Vectors.joined([w for w, _ in found])
    return whole, Vectors.joined([t for _, t in found])


def _alike(rows: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """``numbers`` of rows in blocks of BLOCK at most, halved along the direction in which the rows differ most."""
    if len(numbers) <= BLOCK:
        return [numbers] if len(numbers) else []
    x = rows[numbers] - rows[numbers].mean(axis=0)
    way = np.random.default_rng(1).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(8):
        way = x.T @ (x @ way)
        way /= np.linalg.norm(way) + 1e-12
    half = numbers[np.argsort(x @ way, kind="stable")]
    return _alike(rows, half[: len(half) // 2]) + _alike(rows, half[len(half) // 2 :])


@dataclass
class BlockMaxIndex:
    """Examples as unit vectors, by blocks of those alike."""

    number: np.ndarray  # of the example at each place
    begin: np.ndarray  # the first place of each block
    place: np.ndarray  # of each term among those kept by block, or -1
    blocks: list[np.ndarray]  # weights of those terms, by term and place
    block_max: np.ndarray  # their largest in each block
    first: np.ndarray  # postings of term t are at first[t] to first[t + 1]
    who: np.ndarray
    weight: np.ndarray
    idf: np.ndarray
    alone: float

    @staticmethod
    def build(v: Vectors, idf: np.ndarray, alone: float = 0.0, dense: int | None = None) -> BlockMaxIndex:
        """``alone``: the inverse document frequency of a term without a number."""
        dense, text = DENSE if dense is None else dense, v.texts()
        weight = BlockMaxIndex._weights(v, idf, alone)
        place = np.full(len(idf), -1, dtype=np.int64)
        common = np.argsort(-np.bincount(v.terms, minlength=len(idf)), kind="stable")[:dense]
        place[common] = np.arange(len(common))
        often = place[v.terms] >= 0
        rows = np.zeros((len(v.rest), len(common)), dtype=np.float32)
        rows[text[often], place[v.terms[often]]] = weight[often]
        parts = _alike(rows, np.arange(len(v.rest)))
        number = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        at = np.empty(len(number), dtype=np.int64)
        at[number] = np.arange(len(number))
        order = np.flatnonzero(~often)[np.argsort(v.terms[~often], kind="stable")]
        first = np.append(0, np.cumsum(np.bincount(v.terms[~often], minlength=len(idf))))
        return BlockMaxIndex(number, np.cumsum([0, *(len(p) for p in parts)])[:-1], place, [np.ascontiguousarray(rows[p].T) for p in parts],
                             np.array([rows[p].max(axis=0) for p in parts], dtype=np.float32).reshape(len(parts), len(common)),
                             first, at[text[order]].astype(np.int32), weight[order].astype(np.float32), idf, alone)

    @staticmethod
    def _weights(v: Vectors, idf: np.ndarray, alone: float) -> np.ndarray:
        w = (1 + np.log(v.counts)) * idf[v.terms]
        norm = np.sqrt(np.bincount(v.texts(), weights=w * w, minlength=len(v.rest)) + v.rest * alone**2)
        return w / np.maximum(norm[v.texts()], 1e-300)

    def _start(self, v: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Each query's sums over postings for every place, and its weights of the terms that blocks keep."""
        n, size, text, w = len(v.rest), len(self.number), v.texts(), self._weights(v, self.idf, self.alone)
        often = self.place[v.terms] >= 0
        q = np.zeros((n, self.block_max.shape[1]), dtype=np.float32)
        q[text[often], self.place[v.terms[often]]] = w[often]
        out = np.zeros(n * size, dtype=np.float32)
        terms, text, w = v.terms[~often], text[~often], w[~often]
        many = self.first[terms + 1] - self.first[terms]
        upto = np.cumsum(many)
        i = 0
        while i < len(terms):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS, side="right")))
            m = many[i:j]
            at = np.arange(m.sum()) + np.repeat(self.first[terms[i:j]] - (np.cumsum(m) - m), m)
            low, high = text[i] * size, (text[j - 1] + 1) * size
            cell = np.repeat(text[i:j] * size - low, m) + self.who[at]
            out[low:high] += np.bincount(cell, weights=self.weight[at] * np.repeat(w[i:j], m), minlength=high - low)
            i = j
        return out.reshape(n, size), q

    def _add(self, score: np.ndarray, q: np.ndarray, wanted: np.ndarray) -> None:
        """Complete the scores of the wanted (query, block)."""
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            rows, a = np.flatnonzero(wanted[:, b]), self.begin[b]
            score[rows, a : a + self.blocks[b].shape[1]] += q[rows] @ self.blocks[b]

    def nearest(self, v: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the ``k`` nearest examples of each query, best first, of equals the first; -1: none."""
        n, size = len(v.rest), len(self.number)
        best, who = np.zeros((n, k), dtype=np.float32), np.full((n, k), -1, dtype=np.int64)
        if not size:
            return best, who
        for a in range(0, n, ROWS):
            score, q = self._start(v.part(a, min(a + ROWS, n)))
            bound = np.maximum.reduceat(score, self.begin, axis=1) + q @ self.block_max.T
            ahead = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(ahead, np.argpartition(-bound, min(AHEAD, bound.shape[1]) - 1, axis=1)[:, :AHEAD], True, axis=1)
            self._add(score, q, ahead)
            # The k-th largest of the maxima of small groups is at most the k-th best.
            group = np.maximum.reduceat(score, np.arange(0, size, GROUP), axis=1)
            least = np.partition(group, -k, axis=1)[:, -k, None] if group.shape[1] >= k else np.zeros((len(score), 1))
            # What stays below its k-th best needs no more than the sum it has.
            self._add(score, q, (bound > np.maximum(least - _EPS, 0)) & ~ahead)
            # Equal but for rounding is equal, and then the number decides.
            key = np.rint(score / _EPS).astype(np.int64) * size + (size - 1 - self.number)
            top = np.argpartition(-key, k, axis=1)[:, :k] if size > k else np.broadcast_to(np.arange(size), key.shape)
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, axis=1), axis=1), axis=1)
            found = np.take_along_axis(score, top, axis=1)
            some = found > _EPS
            best[a : a + ROWS, : top.shape[1]], who[a : a + ROWS, : top.shape[1]] = np.where(some, found, 0), np.where(some, self.number[top], -1)
        return best, who


def votes(cosine: np.ndarray, label: np.ndarray, valid: np.ndarray, least: float = TOLD) -> np.ndarray:
    """Votes for label 1, each weighted by its nearness, from distance ``least`` on; nan without a neighbour."""
    weight = np.where(valid, 1 / (least + np.maximum(0, 1 - cosine)), 0)
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight * label).sum(axis=1) / np.maximum(total, 1e-12), np.nan)


def _logit(vote: np.ndarray) -> np.ndarray:
    v = np.clip(vote, 0.01, 0.99)
    return np.log(v / (1 - v))


def _design(whole: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Columns of the fit: one, the vote of whole texts, that of telling terms, and whether there is one."""
    some = ~np.isnan(telling)
    return np.stack([np.ones(len(whole)), _logit(whole), np.where(some, _logit(np.where(some, telling, 0.5)), 0), some], axis=1)


@dataclass
class Model:
    vocabulary: np.ndarray
    told: np.ndarray  # hashes of the telling terms
    whole: BlockMaxIndex
    telling: BlockMaxIndex
    label: np.ndarray
    ids: np.ndarray
    beta: np.ndarray
    alone: float

    def votes(self, whole: Vectors, told: Vectors, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Votes of whole texts and of telling terms, and the former's cosines and numbers; ``own``: the queries' numbers, which do not vote on themselves."""
        k, out = NEIGHBOURS + (own is not None), []
        for index, v, least in ((self.whole, whole, COPY), (self.telling, told, TOLD)):
            cosine, who = index.nearest(v, k)
            valid = (who >= 0) & (who != own[:, None]) if own is not None else who >= 0
            out += [votes(cosine, np.where(valid, self.label[who] if len(self.label) else 0, 0), valid, least), cosine, who]
        return out[0], out[3], out[1], out[2]

    def score(self, whole: Vectors, told: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, and cosines and numbers of the nearest whole texts."""
        voted, by_telling, cosine, who = self.votes(whole, told)
        some = ~np.isnan(voted)
        score = np.full(len(voted), self.alone)
        score[some] = 1 / (1 + np.exp(-(_design(voted[some], by_telling[some]) @ self.beta)))
        return score, cosine, who

    @staticmethod
    def fit(texts: list[bytes], label: np.ndarray, ids: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, told: np.ndarray,
            having: np.ndarray, n_docs: int) -> Model:
        """``having``: how many of all documents have each word of the vocabulary, then each telling term."""
        whole, telling = all_views(texts, vocabulary, told)
        idf, alone = np.log((1 + n_docs) / (1 + having)) + 1e-3, float(np.log((1 + n_docs) / 2) + 1e-3)
        model = Model(vocabulary, told, BlockMaxIndex.build(whole, idf[: len(vocabulary)], alone), BlockMaxIndex.build(telling, idf[len(vocabulary) :]),
                      label, ids, np.zeros(4), 0.0)
        by_whole, by_telling, _, _ = model.votes(whole, telling, np.arange(len(texts)))
        model.beta, model.alone = calibrate(by_whole, by_telling, label, weight)
        return model


def _fit(design: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Coefficients of a weighted logistic fit."""
    beta, ridge = start, np.eye(len(start)) * 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (w * (y - p)) - 0.01 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def calibrate(whole: np.ndarray, telling: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients for the columns of both votes, those of votes not negative, and the score of a text without neighbours.

    That is the rate of label 1 among examples whose telling terms do not speak for it, drawn to that of all."""
    some = ~np.isnan(whole)
    design, y, w = _design(whole[some], telling[some]), label[some].astype(float), weight[some]
    use = np.ones(4, dtype=bool)
    while True:
        beta = np.zeros(4)
        beta[use] = _fit(design[:, use], y, w, np.array([0.0, 1.0, 1.0, 0.0])[use])
        if (beta[1:3] >= 0).all():
            break
        use[1:3] &= beta[1:3] >= 0
    none, prior = ~(telling >= 0.5), (weight * label).sum() / max(weight.sum(), 1e-12)
    return beta, float(((weight * label)[none].sum() + prior) / (weight[none].sum() + 1))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, term, word) of each text's distinct words and beginnings of words; ``word``: whether it is the former."""
    for b in batches:
        texts, label = _text.as_bytes(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
        for i, j in _text.chunks(texts):
            parts = list(_text.stems(texts[i:j]))
            h, number = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            word = np.arange(len(h)) < len(parts[0][0])
            order = np.lexsort((~word, h, number))
            h, number, word = h[order], number[order], word[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (number[1:] != number[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(label[i:j][number[new]], pa.int32()), pa.array(h[new].view(np.int64)), pa.array(word[new])], ["label", "term", "word"])


def _frequencies(terms):
    """(term, n): how many of a task's documents have each term, words first; and their number, as term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, telling = terms.value
        n, docs = np.zeros(len(vocabulary) + len(telling), dtype=np.int64), 0
        for b in (part for whole in batches for part in _text.slices(whole)):
            docs += b.num_rows
            for whole, told in views(_text.as_bytes(b.column(0)), vocabulary, telling):
                n += np.bincount(np.concatenate([whole.terms, told.terms + len(vocabulary)]), minlength=len(n))
        some = np.flatnonzero(n)
        for a in range(0, len(some), 1 << 16):
            at = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["term", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([docs], pa.int64())], ["term", "n"])

    return _text.tidy(run)


def _scores(model):
    evidence = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in (part for whole in batches for part in _text.slices(whole)):
            score, shown, ends = [], [], [0]
            for whole, told in views(_text.as_bytes(b.column(1)), m.vocabulary, m.told):
                value, cosine, who = m.score(whole, told)
                cosine, who = cosine[:, :5], who[:, :5]
                some = who >= 0
                score.append(value)
                shown.append((m.ids[who[some]], m.label[who[some]], cosine[some]))
                ends += (ends[-1] + np.cumsum(some.sum(axis=1))).tolist()
            ids, label, cosine = (np.concatenate([s[k] for s in shown] or [np.empty(0)]) for k in range(3))
            struct = pa.StructArray.from_arrays([pa.array(ids.astype(np.int64)), pa.array(label.astype(np.int32)), pa.array(cosine.astype(float))], fields=list(evidence.value_type))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score or [np.empty(0)])), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct), *b.columns[2:]],
                                             ["id", "score", "evidence", *b.schema.names[2:]])

    return _text.tidy(run)


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (id, score, evidence array<struct<id, label, cosine>>) and the columns of ``carry``.

    ``labels`` (id, label 0 or 1) are those to learn from; at most ``examples`` of each label are used, which
    bounds the index that is sent to executors. Ids must be integers. Rows of ``labels`` with a null are left out
    and an id with several labels has its largest. Of several rows of an id that of the smallest hash of its text is the
    example. A null text counts as empty; a text that shares no word with
    any example has no neighbours, no evidence, and as its score the rate of label 1 among examples whose telling terms do not speak for it. ``evidence`` is the
    nearest whole texts. Of neighbours at one cosine those of smaller ids vote. Without labels every
    score is 0. Repeated rows and null ids are rows like others. A very long text is scored as a whole; a worker's memory
    is some 60 times its bytes. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    more = "".join(f", carry_{i} {docs.select(F.col(c)).schema[0].dataType.simpleString()}" for i, c in enumerate(carry))
    known = store.put(labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
                      .groupBy("id").agg(F.max("label").alias("label")))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = known.filter(F.col("label") == 0).orderBy(F.xxhash64("id"), "id").limit(examples).unionByName(
        known.filter(F.col("label") == 1).orderBy(F.xxhash64("id"), "id").limit(examples))
    chosen = store.put(chosen)  # at most 2 * examples pairs of numbers
    taken = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    # One row of each id, that of the smallest hash of its text, so that an id that repeats crowds out no other.
    texts = store.put(rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
                      .select("id", "least.text", "label"))
    a, n1, n0 = F.col("ones"), taken.get(1, 0), taken.get(0, 0)
    b, n = F.col("all") - F.col("ones"), n1 + n0
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (F.lit(float(max(n1, 1) * max(n0, 1))) * F.col("all") * (n - F.col("all")))
    tells = (F.col("all") >= max(LEAST_EXAMPLES, LEAST_SHARE * min(n1, n0))) & (F.col("all") < n) & (chi2 >= LEAST_CHI2)
    # As many rows as the examples have terms, numbers only.
    counted = store.put(texts.select("label", "text").mapInArrow(_text.tidy(_terms_of), "label int, term long, word boolean").groupBy("term").agg(
        F.count("*").alias("all"), F.sum("label").alias("ones"), F.max("word").alias("word")))
    vocabulary = np.sort(counted.filter("word").select("term").toArrow().column(0).to_numpy().view(np.uint64))
    told = counted.filter(tells).orderBy(chi2.desc(), "term").limit(VOCABULARY).select("term").toArrow().column(0)
    told = np.sort(told.to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast((vocabulary, told))
    found = rows.select("text").mapInArrow(_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, count = found.column(0).to_numpy(), found.column(1).to_numpy()
    having = np.zeros(len(vocabulary) + len(told))
    having[term[term >= 0]] = count[term >= 0]
    table = texts.toArrow().sort_by("id")  # the examples, at most 2 * examples texts
    label, ids = table.column("label").to_numpy().astype(np.int64), table.column("id").to_numpy().astype(np.int64)
    weight = np.where(label == 1, total.get(1, 0) / max((label == 1).sum(), 1), total.get(0, 0) / max((label == 0).sum(), 1)).astype(float)
    model = Model.fit(_text.as_bytes(table.column("text")), label, ids, weight / max(weight.max(initial=0), 1e-12), vocabulary, told, having, int(count[term < 0].sum()))
    out = rows.mapInArrow(_scores(spark.sparkContext.broadcast(model)), f"id long, score double, evidence array<struct<id:long,label:int,cosine:double>>{more}")
    return out.select(F.col("id").alias(id_col), "score", "evidence", *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)))
