"""Block naming against plain grouping."""

import hashlib
import re

import pytest

from sparkquiver.llm import exact_dedup as module
from sparkquiver.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, row int, name string"
ROWS = [(1, "a b", 0, "x"), (2, "ab", 1, None), (3, "a  b", 2, "y"), (4, None, 3, "z"), (5, "", 4, None), (6, " \n\t", 5, "q"), (7, "é b", 6, None), (None, "éb", 7, None),
        (8, "x" * 90 + "tail", 8, None), (9, "x" * 50 + " " + "x" * 40 + "tail", 9, None), (10, "x" * 90 + "tale", 10, None), (11, "same", 11, None), (11, "same", 12, None),
        (12, "x" * 94, 13, None), (13, "ba", 14, None), (None, "éb", 15, None)] + [(100 + i, "often " * (1 + i % 2) + "seen", 0, None) for i in range(12)]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", r[1] or "") for r in rows]
    groups = {}
    for i, n in enumerate(norm):
        groups.setdefault(n, []).append(i)
    out = []
    for i, n in enumerate(norm):
        best = min(groups[n], key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((rows[i][0], rows[best][0], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()))
    return groups, sorted(out, key=str)


@pytest.mark.parametrize("block,frequent", [(4096, 64), (8, 64), (8, 3), (1, 2)])
def test_against_brute_force(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    monkeypatch.setattr(module, "FREQUENT_ROWS", frequent)
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = exact_dedup(docs, carry=("row",)).collect()
    groups, want = brute(ROWS)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert sum(r["kept"] for r in got) == len(groups)  # one of each group, repeated rows included
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert sorted(r["row"] for r in got) == sorted(r[2] for r in ROWS)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
