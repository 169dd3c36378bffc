"""Leaks against all windows, and the guarantee of the multi-index."""

import random

import numpy as np

from sparkquiver.llm.decontaminate import RADIUS, Benchmark, HammingIndex, fingerprints, find_leaks, grid_length, lane_bits, lane_sums


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    windows = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for i in range(1500):  # some near ones
        x = int(prints[i % 40])
        for b in rng.choice(64, int(rng.integers(0, 15)), replace=False):
            x ^= 1 << int(b)
        windows[i] = x
    distance = np.bitwise_count(windows[:, None] ^ prints[None, :])
    w, p, d = HammingIndex(prints).within(windows)
    assert set(zip(w.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= RADIUS))))
    assert (d == distance[w, p]).all()


def test_fingerprints():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(3)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    for length in (1, 14, 55, 173, 255, 256, 390):
        for width in {lane_bits(length), 16, 32}:
            got = fingerprints(lane_sums(h, width), length)
            for at in (0, 7, len(got) - 1):
                want = bits[at : at + length].sum(axis=0) >= (length + 1) // 2
                assert int(got[at]) == sum(1 << i for i in range(64) if want[i])
    assert (lane_bits(255), lane_bits(256), lane_bits(32767), lane_bits(32768)) == (8, 16, 16, 32)
    assert len(fingerprints(lane_sums(h, 16), 500)) == 0 and grid_length(1) == 1 and grid_length(40) == 35 and grid_length(1200) > 960


def test_lightly_edited_windows_have_near_fingerprints():
    """Windows of an item's own class, at any length: the multi-index alone finds the item where few words differ."""
    rng = np.random.default_rng(8)
    for n in (16, 40, 120, 300, 1200):
        item = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        text = np.concatenate([rng.integers(1, 1 << 63, 50, dtype=np.uint64), item, rng.integers(1, 1 << 63, 50, dtype=np.uint64)])
        text[50 + n // 2] = 5
        length = grid_length(n)
        ends = fingerprints(lane_sums(item, lane_bits(length)), length)[[0, -1]]
        assert len(HammingIndex(ends).within(fingerprints(lane_sums(text, lane_bits(length)), length))[0]), n


def test_against_all_windows(spark):
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(3000)
    items = [[word() for _ in range(rng.randrange(3, 59))] for _ in range(25)]
    rows, planted = [], []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 200))]
        if i % 2:
            k = rng.randrange(25)
            own = list(items[k])
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.choice([0, -1, rng.randrange(len(own))])] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        rows.append((i, " \n".join(text).upper() if i % 5 == 0 else " ".join(text), 0))
    rows += [(500, None, 0), (501, "", 0), (None, " ".join(items[0]), 0), (502, " ".join(items[1]), 0), (502, " ".join(items[1]), 0)]
    own = Benchmark(list(range(25)), [" ".join(w).encode() for w in items])
    for i, t, _ in rows:
        from sparkquiver.llm import _text

        h = _text.words([(t or "").encode()])[0]
        for k in range(25):
            n = len(own.words[k])
            from sparkquiver.llm.decontaminate import shingle_counts

            best = max((own.similarity(k, shingle_counts(h[s : s + n])) for s in range(max(1, len(h) - n + 1))), default=0) if len(h) else 0
            if best >= 0.75:
                planted.append((i, k, round(best, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, similarity int").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, None), (98, ""), (None, "x y")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(planted, key=str) and len(planted) > 30
    assert find_leaks(docs.filter("doc_id > 999"), bench).count() == 0
    assert find_leaks(docs, bench.filter("item_id > 999")).count() == 0


def _all_pairs(own, rows):
    from sparkquiver.llm import _text
    from sparkquiver.llm.decontaminate import shingle_counts

    out = []
    for i, t in rows:
        h = _text.words([t.encode()])[0]
        for k, item in enumerate(own.words):
            values = [own.similarity(k, shingle_counts(h[s : s + len(item)])) for s in range(max(1, len(h) - len(item) + 1))] if len(h) else [0]
            if max(values) >= 0.75:
                out.append((i, k, values.index(max(values)), round(max(values), 9)))
    return sorted(out)


def test_documents_shorter_than_items(spark):
    rng = random.Random(5)
    items = [["v%d" % rng.randrange(5000) for _ in range(n)] for n in (*range(12, 60), 70, 90, 130, 260)]
    rows = [(1000 * k + cut, " ".join(w[:-cut] if cut % 2 else w[cut:])) for k, w in enumerate(items) for cut in (1, 2, 3, 5, 8, 10)]
    want = _all_pairs(Benchmark(list(range(len(items))), [" ".join(w).encode() for w in items]), rows)
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], round(r["similarity"], 9)) for r in got) == want and len(want) > 150
    assert all(0 <= r["distance"] <= 64 for r in got)


def test_long_items(spark):
    rng = random.Random(6)
    word = lambda: "u%d" % rng.randrange(50_000)
    items = [[word() for _ in range(n)] for n in (300, 600, 1000, 1000)]
    rows = []
    for k, w in enumerate(items):
        for cut in (0.05, 0.06, 0.065, 0.07, 0.2):  # both ends replaced, the middle as it was
            c = int(cut * len(w))
            rows.append((len(rows), " ".join([word() for _ in range(c + 150)] + w[c:-c] + [word() for _ in range(c + 90)])))
        for size in (0.1, 0.13, 0.3):  # the middle replaced
            c = int(size * len(w))
            rows.append((len(rows), " ".join([word() for _ in range(40)] + w[: len(w) // 2] + [word() for _ in range(c)] + w[len(w) // 2 + c :])))
    want = _all_pairs(Benchmark(list(range(4)), [" ".join(w).encode() for w in items]), rows)
    got = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], round(r["similarity"], 9)) for r in got) == want and len(want) > 16


def test_blocks_weigh_alike(spark, monkeypatch):
    rng = random.Random(7)
    common = ["c%d" % i for i in range(12)]
    items = [common + ["k%d" % rng.randrange(900) for _ in range(14)] for _ in range(30)] + [["one", "two"]]
    rows = [(i, " ".join(["x"] * (i % 3) + items[i % 30][: 26 - i // 30] + ["y%d" % j for j in range(i // 30)])) for i in range(180)] + [(500, "one two")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(99, " ")], "item_id long, text string")
    whole = sorted(tuple(r) for r in find_leaks(docs, bench).select("doc_id", "item_id", "first_word", "similarity").collect())
    monkeypatch.setattr("sparkquiver.llm.decontaminate.ITEMS", 8)
    parts = sorted(tuple(r) for r in find_leaks(docs, bench).select("doc_id", "item_id", "first_word", "similarity").collect())
    assert [r[:3] for r in parts] == [r[:3] for r in whole] and len(whole) > 60
    assert all(abs(p[3] - w[3]) < 1e-12 for p, w in zip(parts, whole))
