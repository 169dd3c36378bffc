"""Tokenising whole texts on executors, with a cache of short units.

For two common families of tokenizers the places where no token crosses are known from the bytes on either side, so
a text's ids are those of its units in order, and each distinct unit is encoded once per worker:

- byte-level pre-tokenizers without a normaliser: a unit is a run of letters, digits or signs with the white space
  before it. The pattern ends a match before white space and looks ahead only, so units encode alone as they do in
  place. Texts with other kinds of white space are encoded whole.
- pre-tokenizers that keep only matches of a pattern without white space, after normalisers that act within
  words: a unit is a run of letters, a digit or a run of signs.

Words are cut only between ASCII or Latin-1 letters, ASCII digits and ASCII signs; never after an apostrophe, which
may begin a contraction, and never beside any other character. Texts that hold a token which the tokenizer's file adds
are encoded whole. Units are told apart by 64-bit hashes of their bytes, and all steps but the encoding of new units
are numpy passes over the bytes of many texts.

Any other tokenizer gets whole texts. Tests compare each with whole-text encoding.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from sparkquiver.llm import _text

#: Distinct units that a worker remembers, some 40 bytes each; beyond that it starts anew. This bounds memory, not the
#: result.
CACHE_UNITS = 300_000
#: Bytes of text that are split into units at a time.
GROUP_BYTES = 1 << 18
#: Longer units are encoded without being remembered.
UNIT_BYTES = 256

_CUT = re.compile(rb"(?<![ \t-\r])[ \t-\r]")
_ALNUM = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_RARE_FIRST = (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
_RARE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ASCII_RARE = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")

WHOLE, LEADING, WORDS = "whole", "leading", "words"


def unit_kind(name: str, data: bytes) -> str:
    """Which units hold for a tokenizer file."""
    if not name.endswith(".json"):
        return WHOLE
    spec = json.loads(data)
    if spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
        return WHOLE
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return LEADING
    parts = pre.get("pretokenizers", [])
    split = parts[0] if parts else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    within = {"NFC", "Lowercase", "Replace"}
    norms = (norm or {}).get("normalizers", [])
    if (split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert")
            and pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and [p.get("type") for p in parts[1:]] == ["ByteLevel"] and not parts[1].get("use_regex")
            and not parts[1].get("add_prefix_space")
            and {n.get("type") for n in norms} == within
            and all(n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in norms if n["type"] == "Replace")):
        return WORDS
    return WHOLE


#: Classes of bytes: white space, letters, digits, signs, apostrophes, and what is not cut.
_SPACE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[32, 9, 10, 11, 12, 13]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _APOSTROPHE
#: A unit of one class, with at most one blank before it, is one match of either pattern.
_SIMPLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def _edges(digits_alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether a unit starts, and whether one ends, between bytes of two classes, at 6 x the first + the second."""
    start, end = np.zeros(36, dtype=bool), np.zeros(36, dtype=bool)
    for a in range(6):
        for b in range(6):
            cut = (a != b and {a, b} <= {_LETTER, _DIGIT, _SIGN}) or (a in (_LETTER, _DIGIT) and b == _APOSTROPHE) or (digits_alone and a == b == _DIGIT)
            start[6 * a + b] = cut or (a == _SPACE and b != _SPACE)
            end[6 * a + b] = cut or (a != _SPACE and b == _SPACE)
    return start, end


_EDGES = {False: _edges(False), True: _edges(True)}


class TokenizerFile:
    """A tokenizer's file as bytes (a few MB), to be sent to executors that may not have the file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        if len(self.data) > 64 << 20:
            raise ValueError("a tokenizer file over 64 MB is not sent to executors")
        self.name = os.path.basename(path)
        self.kind = unit_kind(self.name, self.data)
        #: Tokens that the file adds, which are looked for in texts as written.
        spec = {} if self.kind == WHOLE else json.loads(self.data)
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or ()]
        self.suffix: str | None = (spec.get("model") or {}).get("end_of_word_suffix")

    @property
    def version(self) -> str:
        """Digest of the file and of the library that reads it."""
        library = "tokenizers" if self.name.endswith(".json") else "sentencepiece"
        found = __import__(library).__version__
        return hashlib.sha256(f"{library} {found}\n".encode() + self.data).hexdigest()


class _Memory:
    """Distinct units by 64-bit hashes, ascending, with the number of their ids and the ids end to end.

    A unit of at most UNIT_BYTES has its own polynomial hash; the hash also holds the unit's length.
    """

    def __init__(self):
        self.hashes = np.empty(0, dtype=np.uint64)
        self.sizes, self.first = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Units that are not there yet, by ascending hash."""
        at = np.searchsorted(self.hashes, hashes)
        first = np.cumsum(sizes) - sizes + len(self.ids)
        self.hashes, self.sizes, self.first = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.sizes, sizes), (self.first, first)))
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """Ids of texts given as UTF-8 bytes."""

    def __init__(self, file: TokenizerFile, counts_only: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.counts_only, self.added = file.kind, counts_only, file.added
        self.memory = _Memory()
        self.ends_unit: np.ndarray | None = None
        self.line: int | None = None
        if file.name.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(file.data.decode())
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: (e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False))
            if self.kind == WORDS and file.suffix:
                ends = [i for t, i in model.get_vocab().items() if t.endswith(file.suffix)]
                self.ends_unit = np.zeros(max(ends, default=0) + 1, dtype=bool)
                self.ends_unit[ends] = True
            elif self.kind == LEADING and len(line := next(iter(self._encode(["\n"])))) == 1:
                self.line = line[0]
        else:
            from sentencepiece import SentencePieceProcessor

            piece = SentencePieceProcessor(model_proto=file.data)
            self._encode = lambda texts: iter(piece.encode(texts, num_threads=1)) if texts else iter(())

    def _values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and the ids of all."""
        sizes, flat = np.zeros(len(texts), dtype=np.int64), []
        for a in range(0, len(texts), 4096):
            for i, ids in enumerate(self._encode([t.decode("utf-8", "replace") for t in texts[a : a + 4096]]), a):
                sizes[i] = len(ids)
                flat.append(np.array(ids, dtype=np.uint32))
        return sizes, np.concatenate(flat) if flat else np.empty(0, dtype=np.uint32)

    def _joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """As ``_values``, for simple units, which are encoded together: ids tell where each of them ends."""
        sizes, flat = [], []
        for a in range(0, len(units), 4096):
            part = units[a : a + 4096]
            if self.kind == WORDS:
                if self.ends_unit is None:
                    return None
                ids = np.array(next(iter(self._encode([b" ".join(part).decode()]))), dtype=np.uint32)
                ends = np.flatnonzero(self.ends_unit[np.minimum(ids, len(self.ends_unit) - 1)] & (ids < len(self.ends_unit))) + 1
                sizes.append(np.diff(ends, prepend=0))
            else:
                if self.line is None:
                    return None
                ids = np.array(next(iter(self._encode([b"\n".join(part).decode() + "\n"]))), dtype=np.uint32)
                line = ids == self.line
                ends = np.flatnonzero(line)
                sizes.append(np.diff(ends, prepend=-1) - 1)
                ids = ids[~line]
            if len(ends) != len(part) or sizes[-1].sum() != len(ids):
                return None  # the file has tokens that end otherwise
            flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def _in_units(self, text: bytes) -> bool:
        """Whether the text's ids are those of its units."""
        if self.kind == WHOLE or any(t in text for t in self.added):
            return False
        if self.kind == LEADING:
            return not any(c in text for c in _ASCII_RARE) and (text.isascii() or not (any(c in text for c in _RARE_FIRST) and _RARE_SPACE.search(text)))
        return True

    def _grouped(self, texts: Iterable[bytes]) -> Iterator[list[tuple[int, bytes]]]:
        """Parts of texts with the number of their text; a long text is cut where a unit ends."""
        group, size = [], 0
        for i, text in enumerate(texts):
            start = 0
            if len(text) > GROUP_BYTES and self._in_units(text):
                while len(text) - start > GROUP_BYTES and (m := _CUT.search(text, start + GROUP_BYTES // 2)):
                    if group:
                        yield group
                    yield [(i, text[start : m.start()])]
                    group, size, start = [], 0, m.start()
            group.append((i, text[start:] if start else text))
            size += len(text) - start
            if size > GROUP_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Remember distinct units, given by ascending hash, that are not known yet."""
        if len(self.memory.hashes) > CACHE_UNITS:
            self.memory = _Memory()
        simple = np.array([_SIMPLE.fullmatch(u) is not None for u in units], dtype=bool)
        some = np.flatnonzero(simple)
        found = self._joined([units[i] for i in some.tolist()]) if len(some) else None
        if found is None:
            some = some[:0]
            found = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint32)
        rest = np.setdiff1d(np.arange(len(units)), some, assume_unique=True)
        more = self._values([units[i] for i in rest.tolist()])
        sizes, ids = np.concatenate([found[0], more[0]]), np.concatenate([found[1], more[1]])
        order = np.argsort(np.concatenate([some, rest]), kind="stable")
        first = np.cumsum(sizes) - sizes
        self.memory.add(hashes, sizes[order], ids[_spans(first[order], sizes[order])] if not self.counts_only else ids[:0])

    def _group(self, texts: list[bytes]) -> list:
        """Values of texts that may be encoded unit by unit."""
        raw, number, start, end = _units(texts, leading=self.kind == LEADING)
        long = end - start > UNIT_BYTES
        hashes = _text.range_hash(raw, start, end, lower=self.kind == WORDS)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = np.flatnonzero(~self.memory.find(distinct)[1])
        if len(own):
            data = raw.tobytes()
            a, z = start[at[own]], end[at[own]]
            short = ~long[at[own]]
            # Only ASCII is lowered here, as the normaliser does.
            fold = bytes.lower if self.kind == WORDS else bytes
            self._learn(distinct[own[short]], [fold(data[i:j]) for i, j in zip(a[short].tolist(), z[short].tolist())])
        place, known = self.memory.find(distinct)
        sizes, first, ids = self.memory.sizes, self.memory.first, self.memory.ids
        other = np.flatnonzero(~known)  # too long to be remembered, or forgotten when the memory was full
        if len(other):
            data = raw.tobytes()
            if any(data[start[i] : end[i]] != data[start[j] : end[j]] for i in np.flatnonzero(long).tolist() for j in (at[which[i]],)):
                return self._whole(texts)  # crafted texts: long units of one hash that differ
            more, new = self._values([data[i:j] for i, j in zip(start[at[other]].tolist(), end[at[other]].tolist())])
            place[other] = len(sizes) + np.arange(len(other))
            first = np.concatenate([first, len(ids) + np.cumsum(more) - more])
            sizes, ids = np.concatenate([sizes, more]), np.concatenate([ids, new])
        n = sizes[place[which]]
        total = np.bincount(number, weights=n, minlength=len(texts)).astype(np.int64)
        if self.counts_only:
            return total.tolist()
        flat = ids[_spans(first[place[which]], n)].astype("<u4", copy=False)
        cut = np.append(0, np.cumsum(total)).tolist()
        return [flat[i:j].tobytes() for i, j in zip(cut, cut[1:])]

    def _whole(self, texts: list[bytes]) -> list:
        sizes, ids = self._values(texts)
        if self.counts_only:
            return sizes.tolist()
        cut = np.append(0, np.cumsum(sizes)).tolist()
        return [ids[i:j].astype("<u4", copy=False).tobytes() for i, j in zip(cut, cut[1:])]

    def encode(self, texts: list[bytes]) -> list:
        """For each text its number of ids, or its ids as little-endian unsigned 32-bit numbers."""
        out: list = [0 if self.counts_only else b""] * len(texts)
        for group in self._grouped(texts):
            fits = [self._in_units(t) for _, t in group]
            for wanted, run in ((True, self._group), (False, self._whole)):
                part = [x for x, f in zip(group, fits) if f == wanted]
                for (i, _), value in zip(part, run([t for _, t in part]) if part else ()):
                    out[i] = out[i] + value if out[i] else value
        return out


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, end to end."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - size), size)


def _units(texts: list[bytes], leading: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array of bytes, and the text number, start and end of each unit in it.

    If ``leading``, units begin with the white space before them, and white space at the end of a text is a unit of
    its own.
    """
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", dtype=np.uint8)
    size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_end = np.cumsum(size + 1)
    kind = _CLASS[raw]
    latin = np.flatnonzero(raw == 0xC3)
    latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    starts, ends = _EDGES[not leading]
    edge = kind[:-1] * np.uint8(6) + kind[1:]
    start, end = np.flatnonzero(starts[edge]) + 1, np.flatnonzero(ends[edge]) + 1
    number = np.searchsorted(text_end, start, side="right")
    if not leading:
        return raw, number, start, end
    text_start = text_end - size
    begin = np.maximum(np.append(0, end[:-1]), text_start[number]) if len(end) else end
    # What is left at each text's end: from its last word on, or the whole of a text without words.
    last = text_start.copy()
    np.maximum.at(last, number, end)
    rest = np.flatnonzero(last < text_end)
    begin, end, number = np.concatenate([begin, last[rest]]), np.concatenate([end, text_end[rest]]), np.concatenate([number, rest])
    order = np.argsort(begin, kind="stable")
    return raw, number[order], begin[order], end[order]


_encoders: dict[tuple[str, bool], Encoder] = {}
_text.HELD["encoder"] = _encoders


def encoder(file: TokenizerFile, counts_only: bool) -> Encoder:
    """The worker's encoder; it lasts from task to task."""
    key = (hashlib.sha256(file.data).hexdigest(), counts_only)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(file, counts_only)
        _text.release()  # what reading the file took
    return _encoders[key]
