"""Statistics, trees and the classifier."""

import numpy as np

from sparkquiver.llm.quality import FEATURES, fit_quality, grow, score_quality, statistics


def test_statistics():
    texts = [b"", b"One two two.\nOne two two.\n", "ÉCOLE!! | a".encode(), b"x" * 500]
    s = {n: statistics(texts)[:, i] for i, n in enumerate(FEATURES)}
    assert (statistics(texts)[0] == 0).all()
    assert s["distinct_lines"][1] == 0.5 and s["distinct_words"][1] == 3 / 6 and abs(s["log_words"][1] - np.log(7)) < 1e-12
    assert s["exclamation"][2] > 0 and s["bar"][2] > 0 and s["longest_word"][3] == 500
    assert np.array_equal(statistics(texts[::-1])[::-1], statistics(texts))


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = grow(x[:2000], y[:2000], trees=40, depth=3)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # flattened traversal against walking one row at a time
    for row in x[:20]:
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += v[node - len(f)]
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_classifier(spark):
    good = [(i, "A quiet sentence follows another one here, number %d. It ends." % i, 1) for i in range(80)]
    bad = [(100 + i, "BUY!! NOW!! %d!! | | | $$$ ###" % i, 0) for i in range(80)]
    odd = [(900, None, 0), (901, "", 0), (None, "BUY!! NOW!!", 0), (902, "calm words " * 20_000, 0), (902, "calm words", 0), (902, "calm words", 0)]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score int").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in (good + bad)[::2]] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    got = [(r["doc_id"], r["score"]) for r in score_quality(docs, model).collect()]
    assert len(got) == 166 and all(0 <= s <= 1 for _, s in got)
    assert all((s > 0.5) == (i < 100) for i, s in got if i is not None and i < 900)
    assert score_quality(docs.filter("doc_id > 9999"), model).count() == 0
    empty = fit_quality(docs, labels.filter("doc_id > 9999"))
    assert {r["score"] for r in score_quality(docs, empty).collect()} == {0.5}


def test_repeated_id_counts_once(spark):
    from sparkquiver.llm.quality import labelled_sample

    docs = spark.createDataFrame([(1, f"row {k % 9}") for k in range(300)] + [(i, f"text {i}") for i in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, labelled_sample(d, labels, 100, "doc_id", "text", "quality").collect())) for d in (docs, docs.repartition(4)))
    assert one == two and len(one) == 11
