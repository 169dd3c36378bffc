"""Nearest examples against all cosines, and end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquiver.llm import _text
from sparkquiver.llm.toxicity import BlockMaxIndex, Vectors, all_views, calibrate, score_toxicity, votes


def vectors(rng, count, terms, most):
    """Random texts as entries, and as rows of weights without idf."""
    size = rng.integers(0, most, count)
    term = np.concatenate([np.sort(rng.choice(terms, n, replace=False)) for n in size])
    return Vectors.of(np.repeat(np.arange(count), size), term, rng.integers(1, 5, len(term)), rng.uniform(0, 9, count))


def unit_rows(v, idf, alone):
    out = np.zeros((len(v.rest), len(idf)))
    out[v.texts(), v.terms] = (1 + np.log(v.counts)) * idf[v.terms]
    return out / np.maximum(np.sqrt((out * out).sum(axis=1) + v.rest * alone**2), 1e-12)[:, None]


@pytest.mark.parametrize(("dense", "most"), [(80, 9), (20, 40), (0, 30)])
def test_block_max_index_is_exact(dense, most):
    rng = np.random.default_rng(dense)
    examples, queries, idf = vectors(rng, 700, 300, most), vectors(rng, 200, 300, most), rng.uniform(0.5, 6, 300)
    index = BlockMaxIndex.build(examples, idf, 7.0, dense)
    all_ = unit_rows(queries, idf, 7.0) @ unit_rows(examples, idf, 7.0).T
    for k in (7, 750):
        cosine, who = index.nearest(queries, k)
        want = -np.sort(-all_, axis=1)[:, :k]
        assert np.allclose(cosine[:, :700], np.where(want > 1e-5, want, 0), atol=2e-5)
        assert all(j < 0 or abs(all_[i, j] - c) < 1e-5 for i in range(200) for c, j in zip(cosine[i], who[i]))


def test_blocks_are_passed_over():
    """Examples of two kinds: a query of one leaves most blocks of the other alone, and still finds its nearest."""
    rng = np.random.default_rng(5)
    one, two = vectors(rng, 1000, 100, 20), vectors(rng, 1000, 100, 20)
    both = Vectors.joined([one, Vectors(two.first, two.terms + 100, two.counts, two.rest)])
    index, done = BlockMaxIndex.build(both, np.ones(200), 1.0, 200), []
    add = index._add
    index._add = lambda score, q, wanted: (done.append(wanted.sum()), add(score, q, wanted))
    _, who = index.nearest(one.part(0, 100), 5)
    assert (who < 1000).all() and sum(done) < 0.6 * 100 * len(index.blocks)


def test_votes_and_calibration():
    v = votes(np.array([[1.0, 0.2], [0.0, 0.0]]), np.array([[1, 0], [0, 0]]), np.array([[True, True], [False, False]]))
    assert v[0] > 0.9 and np.isnan(v[1])
    rng = np.random.default_rng(1)
    vote = rng.uniform(0, 1, 4000)
    label = (rng.uniform(0, 1, 4000) < vote).astype(int)
    none = np.full(4001, np.nan)
    beta, alone = calibrate(np.append(vote, np.nan), none, np.append(label, 0), np.ones(4001))
    p = 1 / (1 + np.exp(-(beta[1] * np.log(vote / (1 - vote)) + beta[0])))
    assert abs(p[vote > 0.8].mean() - label[vote > 0.8].mean()) < 0.05 and alone < 0.5


def test_end_to_end(spark):
    clean = [(i, f"the quiet house {i} stood by the river bend", 1) for i in range(40)]
    toxic = [(100 + i, f"you are a vile rotten creature number {i}", 1) for i in range(40)]
    odd = [(500, None, 1), (501, "", 1), (None, "vile rotten", 1), (502, "unknown words only", 1), (503, "such a vile rotten thing " * 3000, 1), (503, "such a vile rotten thing", 1)]
    docs = spark.createDataFrame(clean + toxic + odd, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _, _ in (clean + toxic)[::2]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["row"]): r for r in score_toxicity(docs.selectExpr("*", "length(text) AS row"), labels, carry=("row",)).collect()}
    assert len(got) == 86
    assert all((r["score"] >= 0.5) == (100 <= i < 500) for (i, _), r in got.items() if i is not None and i < 500)
    assert got[(None, 11)]["score"] > 0.5 and got[(503, 75000)]["score"] > 0.5
    assert got[(501, 0)]["score"] < 0.5 and got[(501, 0)]["evidence"] == []
    assert got[(100, len(toxic[0][1]))]["evidence"][0]["label"] == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert score_toxicity(docs.filter("doc_id > 5"), none).count() == 0


def test_views_of_whole_texts():
    """Both views against a plain count of words and of beginnings of words."""
    texts = [b"", b"One two, ONE two three-four", "Verl\u00e4sslich w\u00f6rter w\u00f6rter".encode(), b"unknown " * 300000 + b"one", b"\n \t"]
    hash_of = lambda t: next(_text.stems([t]))[0][0]
    begin = next(p for p in list(_text.stems([b"unknown"]))[1:] if len(p[0]))[0][0]
    vocabulary = np.sort(np.array([hash_of(w) for w in (b"one", b"two", "w\u00f6rter".encode())], dtype=np.uint64))
    told = np.sort(np.array([begin, hash_of(b"two")], dtype=np.uint64))
    whole, telling = all_views(texts, vocabulary, told)
    at = {w: int(np.searchsorted(vocabulary, hash_of(w))) for w in (b"one", b"two", "w\u00f6rter".encode())}
    got = [dict(zip(p.terms.tolist(), p.counts.tolist())) for p in (whole.part(i, i + 1) for i in range(5))]
    assert got == [{}, {at[b"one"]: 2, at[b"two"]: 2}, {at["w\u00f6rter".encode()]: 2}, {at[b"one"]: 1}, {}]
    assert np.allclose(whole.rest, [0, 2, 1, (1 + np.log(300000)) ** 2, 0])
    k = int(np.searchsorted(told, begin))
    assert [dict(zip(p.terms.tolist(), p.counts.tolist())) for p in (telling.part(i, i + 1) for i in range(5))] == [{}, {1 - k: 2}, {}, {k: 300000}, {}]


def test_copy_without_telling_terms(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 9)) for _ in range(12))
    own = [(i, text()) for i in range(60)] + [(100 + i, text() + (" vile rotten" if i >= 10 else "")) for i in range(40)]
    copies = [(1000 + i, t) for i, t in own]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in own], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(spark.createDataFrame(own + copies, "doc_id long, text string"), labels).collect()}
    for i, _ in own:  # the ten toxic ones without a telling term as well
        first = got[1000 + i]["evidence"][0]
        assert first["id"] == i and first["cosine"] > 0.999 and (got[1000 + i]["score"] >= 0.5) == (i >= 100)


def test_repeated_id_crowds_out_nothing(spark):
    clean = [(i, f"the quiet house {i} stood by the river bend") for i in range(20)]
    toxic = [(100 + i, f"you are a vile rotten creature number {i}") for i in range(20)]
    hot = [(7, f"a repeated row {k % 50}") for k in range(400)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int")
    docs = spark.createDataFrame(hot + clean + toxic + [(900, "quite a vile rotten creature")], "doc_id long, text string").coalesce(1)
    first, again = ({(r["doc_id"], r["score"], str(r["evidence"])) for r in score_toxicity(d, labels, examples=20).collect()} for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(5)))
    assert {(i, round(s, 6), e) for i, s, e in first} == {(i, round(s, 6), e) for i, s, e in again}
    assert all(s > 0.5 for i, s, _ in first if i == 900)
