"""Byte-level hashing against plain Python."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkquiver.llm import _text

TEXT = st.text(alphabet="aAbB zZé\n\t\x0b\x1c ß漢", max_size=40)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def plain_shingles(text: bytes):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_and_shingles(texts):
    data = [t.encode() for t in texts]
    seen = {}
    for a, b in _text.chunks(data):
        h, number, start, end = _text.words(data[a:b])
        flat = [w for t in data[a:b] for w in WORD.findall(t.translate(LOWER))]
        assert len(flat) == len(h)
        for w, x in zip(flat, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    names = {}
    for a, sets in _text.document_shingles(data):
        for t, s in zip(data[a:], sets):
            want = plain_shingles(t)
            assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
            assert names.setdefault(frozenset(want), s.tolist()) == s.tolist()


def test_chunks_do_not_change_hashes(monkeypatch):
    data = [b"one two three four five six " * 50, b"", b"x", b"one two three four five six"]
    want = [s.tolist() for _, sets in _text.document_shingles(data) for s in sets]
    monkeypatch.setattr(_text, "CHUNK_BYTES", 64)
    monkeypatch.setattr(_text, "_powers", [])
    assert [s.tolist() for _, sets in _text.document_shingles(data) for s in sets] == want
    assert want[0][0] == sorted(want[0])[0] and want[1] == [] and len(want[2]) == 1
