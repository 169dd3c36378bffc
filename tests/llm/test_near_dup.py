"""The similarity join against all pairs."""

import random

import numpy as np
import pytest

from sparkquiver.llm import near_dup as module
from sparkquiver.llm._components import components, roots
from sparkquiver.llm._store import Store
from sparkquiver.llm.near_dup import choose_prefix, most_matches, near_duplicates, needed_overlap
from tests.llm.test_text import plain_shingles

SCHEMA = "doc_id long, text string, row long, tokens string"


def corpus():
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(400)
    out = []
    shared = [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rng.choice([3, 5, 6, 12, 40, 120]))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = shared  # a passage that many documents hold
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy) if rng.random() < 0.8 else "\n ".join(copy).upper())
    return [(i, t, 7, None) for i, t in enumerate(out)] + [(9000, None, 1, None), (9001, "", 1, None), (9002, " \t", 1, None), (9003, "one", 1, None), (9004, "ONE", 1, None), (9004, "ONE", 1, None), (None, "one", 2, None)]


def brute(rows):
    sets = [plain_shingles((r[1] or "").encode()) for r in rows]
    link = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            for j in link[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        out.append((rows[i][0], len(sets[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), len(link[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks,broadcast", [(256, 1 << 20), (4, -1)])
def test_against_brute_force(spark, monkeypatch, blocks, broadcast):
    monkeypatch.setattr(module, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == brute(rows)
    first = {}
    for r in got:
        if r["n_shingles"] and r["first"]:
            first.setdefault(r["component_id"], set()).add(r["__key"])
    assert all(len(v) == 1 for v in first.values()) and set(first) == {r["component_id"] for r in got if r["n_shingles"]}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None, 1, None)], SCHEMA).filter("doc_id = 1")).count() == 1


def test_prefixes_lose_no_pair():
    """Linked sets share enough shingles of their prefixes, whatever each chooses."""
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        change = int(n * rng.uniform(0, 0.25))
        b = np.concatenate([a[change:], rng.integers(1, 1 << 62, int(change * rng.uniform(0, 1))).astype(np.uint64)])
        more = [rng.choice(a, max(1, n // 3), replace=False) for _ in range(int(rng.integers(0, 6)))]
        sets = [np.unique(s) for s in (a, b, *more)]
        posted = []
        for s in sets:
            first = s[s % np.uint64(module.FIRST_OF) == 0]
            m = len(s)
            all_ = len(first) < m - needed_overlap(np.int64(m)) + most_matches(np.int64(m))
            posted.append((m, len(first), all_, s if all_ else first))
        values, counts = np.unique(np.concatenate([p[3] for p in posted]), return_counts=True)
        df = dict(zip(values.tolist(), counts.tolist()))
        chosen = []
        for m, f, all_, tokens in posted:
            t = np.array([x for x in tokens.tolist() if df[x] > 1], dtype=np.uint64)
            chosen.append(choose_prefix(m, f, bool(all_), t.view(np.int64), np.array([df[x] for x in t.tolist()], dtype=np.int64)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    shared = len(np.intersect1d(chosen[i][1], chosen[j][1]))
                    assert shared >= min(chosen[i][0], chosen[j][0])


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = np.concatenate([rng.integers(0, 60, (40, 2)), [[100 + i, 101 + i] for i in range(30)], [[200, 300 + i] for i in range(20)]])
    nodes, root = roots(edges[:, 0], edges[:, 1])
    want = {(int(a), int(b)) for a, b in zip(nodes, root) if a != b}
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "x long, y long").repartition(5)
    assert {tuple(r) for r in components(df, Store(spark)).collect()} == want
    assert components(df.filter("x < 0"), Store(spark)).count() == 0


def test_a_giant_cluster_is_not_all_pairs(spark, monkeypatch):
    """A chain of documents and a hot shingle: who shares a shingle meets in a task, and few others do."""
    monkeypatch.setattr(module, "BLOCK_DOCS", 16)
    chain = [(i, 0, 100 if i % 2 else 120, [i, i + 1], i) for i in range(3000)]
    hot = [(5000 + i, 0, 100, [i % 50, 7777], 7777) for i in range(200)]
    alive = spark.createDataFrame(chain + hot + [(9000, 1, 5, [1, 2], 1)], "row long, cluster long, n long, prefix array<long>, home long")
    tasks = [tuple(r) for r in module.block_tasks(alive, Store(spark)).collect()]
    meets, own = {}, {}
    for row, _, block, b1, b2 in tasks:
        assert own.setdefault(row, block) == block in (b1, b2)
        meets.setdefault(row, set()).add((b1, b2))
    prefix = {r[0]: set(r[3]) for r in chain + hot}
    holders = {}
    for row, p in prefix.items():
        for t in p:
            holders.setdefault(t, []).append(row)
    for rows in holders.values():
        for i in rows:
            assert all((min(own[i], own[j]), max(own[i], own[j])) in meets[i] for j in rows)
    assert 9000 not in own and len(tasks) < 6 * len(prefix) and len({(b1, b2) for _, _, _, b1, b2 in tasks}) < 4000  # of some 20,000 pairs of blocks


def test_very_long_and_clashing(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(120_000))
    docs = spark.createDataFrame([(1, long, 3, "x"), (2, long + " more words at the end", 3, "x"), (3, "short text", 3, "x")], "doc_id long, text string, n long, token string")
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
