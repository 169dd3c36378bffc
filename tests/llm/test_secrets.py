"""Spans against plain regular expressions, and the battery on strings of known origin."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkquiver.llm.secrets import BINS_PER_TEN, ENCODINGS, FDR, find_secrets, normal_tail, ordinary, randomness, rejection_levels

KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
BASE = (("assign", re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24))
RNG = random.Random(4)
KEY = "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))
TEXTS = [None, "", "plain text", "secret: token: abcdefg", 'PassWord = "hunter22x"', "token=token=abcdef", "é🙂 api_key: 'k.k.k.k-k' and apikey=short", "x" * 50 + "AKIA" + "Q" * 16 + "! AKIA12",
         "AKIAAKIA" + "7" * 15, "0123456789abcdef01234567 and 0123456789abcdef0123456", "ſecret=abcdefgh toKen=abcdefgh", f"use {KEY} here", f"token={KEY}",
         "some/very/ordinary/path-to_a_file_in_2020/readme" * 2, "password=aaaaaa" * 300, "\n".join(["secret:abc123"] * 3)]


def base_spans(text):
    found = [(m.start(), k, n, m.end()) for k, (n, p, keep) in enumerate(BASE) for m in p.finditer(text or "") if keep(m)]
    return sorted(found)


def test_spans(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], 0), (4, TEXTS[4], 0)], "doc_id long, text string, row int").repartition(3)
    got = find_secrets(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[4 if r["doc_id"] is None else r["doc_id"]]
        assert [tuple(s) for s in r["spans"] if s["kind"] != "random"] == base_spans(text)
    spans = {r["doc_id"]: [(text := TEXTS[r["doc_id"] or 0])[s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "random"] for r in got}
    assert spans[11] == [KEY] and spans[12] == [] and spans[13] == [] and spans[2] == []
    assert find_secrets(docs.filter("doc_id > 999")).count() == 0


def test_battery(spark):
    rng = random.Random(9)
    rows = []
    for name, _, symbols in ENCODINGS[1:]:
        for _ in range(60):
            rows.append((name, "".join(rng.choice(symbols) for _ in range(40)), True))
    words = "the quick brown fox jumps over lazy dog again and then some more of it".split()
    for _ in range(200):
        rows.append(("text", "_".join(rng.choice(words) for _ in range(9)) + "7", False))
    rows += [("runs", "abcdefghij0123456789abcdefghij0123456789", False), ("flat", "a1" * 20, False), ("one", "A" * 30 + "1", False)]
    df = randomness(spark.createDataFrame(rows, "kind string, s string, random boolean"), "s").toPandas()
    assert (df[~df.random].p < 0.01).mean() > 0.95
    assert 0.9 < (df[df.random & df.p.notna()].p > 0.05).mean() <= 1


@pytest.mark.parametrize("z,p", [(0.0, 0.5), (1.0, 0.158655254), (1.959964, 0.025), (4.0, 3.167124e-05)])
def test_normal_tail(spark, z, p):
    assert abs(spark.range(1).select(normal_tail(F.lit(z))).first()[0] - p) < 1e-6


def identifiers(rng):
    """Ordinary names in six forms."""
    words = [w for w in "get user account name value list index build result order config server client handler request response token parser reader writer buffer stream socket thread".split() if w != "token"]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    return [
        "_".join(pick(5)), "-".join(pick(4)) + "-" + str(rng.randrange(2010, 2030)), "".join(w.title() for w in pick(5)) + str(rng.randrange(10)),
        "/".join(pick(4)) + "/v" + str(rng.randrange(9)), "_".join(pick(4)).upper() + "_" + str(rng.randrange(100)), pick(1)[0] + "".join(w.title() for w in pick(4)) + "2",
    ]


def test_ordinary_names_are_not_reported(spark):
    rng = random.Random(12)
    names = [n for _ in range(50) for n in identifiers(rng) if len(n) >= 20]
    keys = ["".join(rng.choice(s) for _ in range(n)) for _, _, s in ENCODINGS[1:] for n in (20, 24, 32, 40, 64) for _ in range(10)]
    keys = [k for k in keys if any(c.isalpha() for c in k) and any(c.isdigit() for c in k)]
    docs = spark.createDataFrame([(i, f"see {x} there") for i, x in enumerate(names + keys)], "doc_id long, text string")
    found = {r["doc_id"] for r in find_secrets(docs).collect() if r["spans"]}
    assert sum(i < len(names) for i in found) <= 0.05 * len(names) and len(names) > 200
    assert sum(i >= len(names) for i in found) >= 0.95 * len(keys)
    alone = docs.filter(F.col("doc_id") < len(names))  # also where there are no keys at all
    assert sum(bool(r["spans"]) for r in find_secrets(alone).collect()) <= 0.05 * len(names)


def test_step_up_rule(spark):
    """Levels against a plain rule on the p-values as the histogram has them."""
    rng = random.Random(3)
    rows = [(e, c, int(-50 * math.log10(p))) for e in ("hex", "base62") for c in (8, 9, 10)
            for p in [rng.random() for _ in range(40)] + [10 ** rng.uniform(-9, -1) for _ in range(rng.choice([0, 1, 5, 30]))]] + [("one", 1, 200), ("two", 1, 10)]
    got = {(r["encoding"], r["length_class"]): r["level"] for r in rejection_levels(spark.createDataFrame(rows, "encoding string, length_class int, bin int")).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        p = sorted((10 ** (-b / BINS_PER_TEN), b) for *k, b in rows if tuple(k) == key)
        passing = [i for i, (x, _) in enumerate(p, 1) if x <= FDR * i / len(p)]
        if passing:
            want[key] = p[max(passing) - 1][1]
    assert got == want and 2 < len(want) < 8


def test_bound_on_ordinary_names(spark):
    """The bound is a p-value under its own model: drawn from it, p0 <= x at most with probability x."""
    from sparkquiver.llm.secrets import FOLLOWS, KIND, LETTERS, SIGNS, STARTS

    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        kind, out = rng.choices(KIND, STARTS)[0], ""
        for _ in range(24):
            c = rng.choice("0123456789") if kind == "d" else rng.choice(SIGNS[2:]) if kind == "p" else rng.choices("abcdefghijklmnopqrstuvwxyz", LETTERS)[0]
            out += c.upper() if kind == "u" else c
            kind = rng.choices(KIND, FOLLOWS[KIND.index(kind)])[0]
        rows.append((out, 24, "base64url"))
    p0 = ordinary(spark.createDataFrame(rows, "s string, n int, encoding string"), "s").toPandas().p0
    assert all((p0 <= x).mean() <= x for x in (0.1, 0.01, 0.001))
