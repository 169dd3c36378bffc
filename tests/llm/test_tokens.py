"""Counts and ids against whole-text encoding, the cache, and packing."""

import functools
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkquiver.llm import _encode, packing
from sparkquiver.llm._encode import Encoder, TokenizerFile
from sparkquiver.llm.packing import best_fit, pack
from sparkquiver.llm.token_counts import count_tokens

paths = pytest.importorskip("public_tokenizers")
NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
FILES = {n: TokenizerFile(str(paths.path(n))) for n in NAMES}


@functools.cache
def model(name):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(FILES[name].data.decode())
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=FILES[name].data)


def whole(name, text):
    return model(name).encode(text, add_special_tokens=False).ids if name.endswith(".json") else model(name).encode(text)


HARD = ["", " ", "\n\n", "a", " a", "a  b", "a\n\nb ", "don't 'tis we'LL  'S", "<|endoftext|>", "x <|endoftext|>y", "X<|ENDOFTEXT|>", "a  b", "a  \nb", "é é ΣΑΣ İ K",
        "ab   c", "日本語 12 345", "🙂🙂 x", "\x1c a\x1f b\x85c", "tab\tnew\r\nline", "A" * 700 + " " + "b" * 300, "1 22 333!!! ... --", "́ a ́", "<|startoftext|> z"]


def test_kinds():
    assert [FILES[n].kind for n in NAMES] == ["leading", "words", "whole"]


@pytest.mark.parametrize("name", NAMES)
def test_hard_texts(name):
    ids = Encoder(FILES[name], counts_only=False).encode([t.encode() for t in HARD])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [whole(name, t) for t in HARD]
    assert Encoder(FILES[name], counts_only=True).encode([t.encode() for t in HARD]) == [len(whole(name, t)) for t in HARD]


_own = {n: Encoder(FILES[n], counts_only=False) for n in NAMES[:2]}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abT'sé \n\t.,!19<|> ́ ß漢\x1c", max_size=30))
def test_any_text(text):
    for n, e in _own.items():
        assert np.frombuffer(e.encode([text.encode()])[0], dtype="<u4").tolist() == whole(n, text)


def test_long_texts_are_cut_where_units_end(monkeypatch):
    monkeypatch.setattr(_encode, "GROUP_BYTES", 64)
    monkeypatch.setattr(_encode, "CACHE_UNITS", 5)
    text = "alpha  beta\n\ngamma delta's " * 40 + "end"
    for n in NAMES[:2]:
        assert Encoder(FILES[n], counts_only=True).encode([text.encode(), b"x y"]) == [len(whole(n, text)), 2]


def test_counts_and_cache(spark, tmp_path):
    rows = [(1, "hello world", 5), (2, None, 5), (3, "", 5), (None, "hello world", 5), (4, "hello  world", 5), (4, "hello  world", 5)]
    docs, cache = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), str(tmp_path / "cache")
    path = str(paths.path("byte_bpe_50k.json"))
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in count_tokens(docs, path, cache).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), len(whole("byte_bpe_50k.json", t or ""))) for i, t, _ in rows], key=str)
    assert spark.read.parquet(cache).count() == 3  # one entry for each distinct text
    more = spark.createDataFrame([(7, "hello world", 0), (8, "something new", 0)], "doc_id long, text string, n_tokens int")
    assert {r["n_tokens"] for r in count_tokens(more, path, cache).collect()} == {2}
    assert spark.read.parquet(cache).count() == 4
    other = count_tokens(more, str(paths.path("piece_bpe_32k.model")), cache)
    assert sorted(r["n_tokens"] for r in other.collect()) == sorted(len(whole("piece_bpe_32k.model", t)) for t in ("hello world", "something new"))
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert count_tokens(docs.filter("doc_id > 99"), path, str(tmp_path / "none")).count() == 0


def test_best_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 500):
        lengths = rng.integers(1, 101, n)
        bins, offsets = best_fit(lengths, 100)
        for b in set(bins.tolist()):
            own = np.argsort(offsets[bins == b])
            assert (offsets[bins == b][own] == np.cumsum(lengths[bins == b][own]) - lengths[bins == b][own]).all() and lengths[bins == b].sum() <= 100
        assert len(set(bins.tolist())) <= math.ceil(1.25 * lengths.sum() / 100) + 1


@pytest.mark.parametrize("group", [20_000, 6])
def test_pack(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_BINS", group)
    rng = np.random.default_rng(1)
    texts = [None, "", "one", "one"] + [" ".join(["word", "an", "I"][int(k)] for k in rng.integers(0, 3, int(n))) for n in rng.integers(1, 90, 60)]
    rows = [(None if i == 3 else i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(7)
    got = pack(docs, str(paths.path("word_bpe_49k.json")), capacity=32, end_id=0, keep_ids=True).collect()
    ids = {i: [*whole("word_bpe_49k.json", t or ""), 0] for i, t, _ in rows}
    times = {i: sum(r[0] == i for r in rows) for i in ids}
    by_doc, by_bin = {}, {}
    for r in got:
        own = np.frombuffer(bytes(r["ids"]), dtype="<u4")
        assert own.tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        assert r["start"] == 32 * r["piece"]
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc == {i: len(x) * times[i] for i, x in ids.items()}
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert len(by_bin) <= math.ceil(sum(by_doc.values()) / 32) * 1.05 + 1
    assert pack(docs.filter("doc_id > 999"), str(paths.path("word_bpe_49k.json"))).count() == 0
