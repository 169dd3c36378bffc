"""Canonical digests."""

import hashlib
import random
import textwrap
from pathlib import Path

import pytest

from sparkquiver.llm.licenses import FULL, KNOWN, canonical_text, digests_of, find_licenses, known_digests


def test_canonical():
    a = "Copyright (c) 2020 Someone\n\n  Permission  is hereby granted, free of charge: sub-license the \"Licence\" — https://x"
    b = "copyright 1999 Else.\n(C) 2001\npermission is hereby granted free of charge sublicense the license http x"
    assert canonical_text(a) == canonical_text(b) == "permission is hereby granted free of charge sublicense the license http x"
    assert len(known_digests()) > 40 and canonical_text("©  only\n") == ""


def test_find(spark):
    mit = next(t for n, t in KNOWN if n == "MIT" and t.startswith("MIT License"))
    rows = [(1, mit.upper().replace("\n\n", "\n\nCopyright 2024 X\n\n", 1), "a"), (2, "Some prose.\n  released under the MIT licence  \nLicensed under CC BY-NC 4.0", "b"),
            (3, None, "c"), (4, "", "d"), (None, "mit licence", "e"), (5, "© 2020\n!!!", "f"), (6, mit + " and more", "g"), (2, "x", "h"), (2, "x", "h"), (7, "word " * 50_000, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string").repartition(3)
    got = find_licenses(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text_license"], tuple(r["licenses"])) for r in got}
    assert by == {(1, "MIT", ("MIT",)), (2, None, ("CC-BY-NC-4.0", "MIT")), (3, None, ()), (4, None, ()), (None, None, ()), (5, None, ()), (6, None, ()), (2, None, ()), (7, None, ())}
    digests = {hashlib.sha256(canonical_text(t or "").encode()).hexdigest() for _, t, _ in rows}
    assert {r["canonical_sha256"] for r in got} == digests
    assert find_licenses(docs.filter("doc_id > 99")).count() == 0


def test_wrapped_anywhere():
    for _, text in KNOWN:
        for width in (1, 14, 20, 33, 60, 66, 70, 72, 78, 80, 100):
            lines = [w for line in text.split("\n") for w in textwrap.wrap(line, width, break_long_words=False, break_on_hyphens=False) or [""]]
            assert canonical_text("\n".join(["Copyright (c) 2024 X", "", *lines])) == canonical_text(text), (width, text)
    assert canonical_text("Copyright Acme Inc.\n(c) Acme\n<copyright notice>\nCopyright [yyyy] [name of copyright owner]\nCopyright The Go Authors\n© X\nx") == "x"
    items = "(c) You must retain\nCopyright holders\ncopyrighted works\ncopyright\nnotice"
    assert canonical_text(items) == "c you must retain copyright holders copyrighted works copyright notice"


def test_against_a_plain_search():
    """Digests of generated documents against canonical forms of every line, paragraph and whole text, one by one."""
    rng, known = random.Random(2), known_digests()
    names = {canonical_text(t): n for n, t in KNOWN}
    found = 0
    for _ in range(150):
        blocks = []
        for _ in range(rng.randrange(1, 5)):
            kind, (_, text) = rng.randrange(4), rng.choice(KNOWN)
            one = " ".join(text.split())
            blocks.append(["prose of no licence at all", one, "\n".join(textwrap.wrap(one, 60)), one + " and more"][kind])
        doc = "\n\n".join(blocks)
        paragraphs = [b for b in doc.split("\n\n")]
        want = {names[c] for c in map(canonical_text, [doc, *paragraphs, *doc.split("\n")]) if c in names}
        whole, parts = digests_of(doc, 50_000)
        got = {known[d] for d in (whole, *parts) if d in known}
        assert want <= got and all(any(names.get(canonical_text(p)) == n for p in (doc, *paragraphs, *doc.split("\n"))) or n in {m for m, _, _ in FULL} for n in got)
        found += len(want)
    assert found > 150


def test_titles():
    known = known_digests()
    body = {n: t for n, t in KNOWN if n in ("BSD-2-Clause", "BSD-3-Clause") and len(t) > 500}
    for name, title in (("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "")):
        assert known.get(digests_of(f"{title}\n\nCopyright (c) 2024, X\nAll rights reserved.\n\n{body[name]}", 0)[0]) == name
    mit = next(t for n, t in KNOWN if n == "MIT" and t.startswith("MIT License"))
    assert known[digests_of("The " + mit, 0)[0]] == "MIT"


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"),
                                        ("LGPL-3", "LGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")])
def test_full_texts(file, name):
    assert name in {n for n, _, _ in FULL}
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no published copy here")
    assert known_digests().get(digests_of(path.read_text(), 0)[0]) == name
