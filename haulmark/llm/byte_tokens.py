"""Token ids of whole texts, each distinct piece encoded about once per worker.

Both supported pre-tokenizers cut at a lone space and where ASCII letters, digits and marks meet, so texts are split
there, a run of texts at a time, and the ids of their pieces are joined. Short pieces and their ids are held in arrays
under all their bytes, in lower case if the vocabulary has no capitals; only pieces not held are encoded, many at a time.
Texts for which the cut is not safe are encoded whole, and those that hold the string of an added token, such as
``<|endoftext|>``, by the library, which gives them that token's id.

The byte-level file is also read as ranks for ``tiktoken``, which gives the same ids several times faster; the tests
compare it with ``tokenizers`` on odd and real texts.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from haulmark.llm.common import U64, mix, slices

# A run of white space is one piece of byte-level pre-tokenization, so a chunk may not touch another white space there.
_RUN = re.compile(r"\s{2}")
# Small letters of Latin-1, Greek and Cyrillic, which normalizing does not change whatever letters stand beside them.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u03ac-\u03ce\u0430-\u045f]+")
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([.,;:!?|&%$*#]+)")
TABLE = 350_000  # chunks held by a worker, about 70 MB
JOINED = 100  # words encoded by one call
_packers = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed(ids: list[int]) -> bytes:
    return _packers[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would also hold memory each
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def plain_tokenizer(path: str) -> Tokenizer:
    """The same model for ``_PLAIN`` words with a space between: there is nothing to normalize, and cuts are at the spaces."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    plain = Tokenizer.from_file(path)
    plain.normalizer = normalizers.Sequence([])
    by_byte = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), by_byte])
    return plain


def _added(path: str) -> tuple[re.Pattern, int]:
    """The strings of the added tokens, which the library looks for before it normalizes, and the largest of their ids."""
    tokens = json.load(open(path, encoding="utf-8")).get("added_tokens") or []
    assert not any(t["normalized"] for t in tokens), "added tokens are matched in the text as it is"
    return re.compile("|".join(re.escape(t["content"]) for t in tokens) or r"(?!)"), max((t["id"] for t in tokens), default=-1)


def _white_run(text: str) -> bool:
    if not text.isascii() or any(c in text for c in "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"):
        return _RUN.search(text) is not None
    return any(c in text for c in ("  ", "\n\n", " \n", "\n "))  # the same, several times faster


def _library(path: str) -> Callable[[list[str]], list[bytes]]:
    def solve(texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]

    return solve


def _runs(ids: np.ndarray, first: np.ndarray, n: int) -> list[bytes] | None:
    """The ids cut before each marked one, if that gives n runs."""
    starts = np.flatnonzero(first)
    if len(starts) != n or (n and starts[0]):
        return None
    raw, ends = ids.astype("<u4").tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


_LETTER, _DIGIT, _MARK, _SPACE, _BREAK = range(1, 6)
_CLASS = np.zeros(256, np.uint8)  # 0: the apostrophe, which contractions join to letters, controls, and all that is not ASCII
_CLASS[33:127] = _MARK
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39], _CLASS[32], _CLASS[10] = 0, _SPACE, _BREAK
_CLASS = _CLASS.tobytes()
_KEY, _SLOTS, _POOL = 15, 1 << 21, 8_000_000  # bytes of a piece that is held, slots (38 MB for all), ids held


class PieceTable:
    """Ids of short pieces of texts, held under their bytes and length in an array of slots (each piece has two).

    The array grows to ``slots`` with the pieces held, as every worker of an executor has one.
    """

    def __init__(self, solve: Callable[[list[str]], list[bytes]], slots: int = _SLOTS, most: int = _POOL):
        self.solve, self.limit, self.most = solve, slots, most
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self._empty(min(slots, 1 << 16))

    def _empty(self, slots: int) -> None:
        self.slots, self.held = slots, 0
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.at, self.n = np.zeros(slots, np.int32), np.zeros(slots, np.uint8)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) >> U64(32)).astype(np.int64) % self.slots

    def _enter(self, *pieces: np.ndarray) -> None:
        """Hold pieces that are not held yet: in their first slot where it is free, else in the second in any case."""
        slot = self._slot(*pieces[:2])
        left = np.arange(len(slot))
        for other in (0, 1):
            going = left if other else left[self.high[slot] == 0]
            where, first = np.unique(slot[going] ^ other, return_index=True)
            self.held += int((self.high[where] == 0).sum())
            for held, x in zip((self.low, self.high, self.at, self.n), pieces, strict=True):
                held[where] = x[going[first]]
            left = np.setdiff1d(left, going[first])

    def _room(self, more: int) -> None:
        """At least four times the slots of what is held and comes, up to the limit: in fuller arrays pieces push others out."""
        slots = self.slots
        while slots < min(4 * (self.held + more), self.limit):
            slots = min(2 * slots, self.limit)
        if slots > self.slots:
            there = np.flatnonzero(self.high)
            pieces = [x[there] for x in (self.low, self.high, self.at, self.n)]
            self._empty(slots)
            self._enter(*pieces)

    def _keep(self, solved: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids, now in the pool."""
        n = np.array([len(x) // 4 for x in solved], np.int64)
        end = self.used + int(n.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(end * 5 // 4 - self.used, np.uint32)])
        self.pool[self.used : end] = np.frombuffer(b"".join(solved), "<u4")
        at, self.used = self.used + np.cumsum(n) - n, end
        return at, n

    def ids(self, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one behind the other, and their number in each piece."""
        if self.used > self.most:
            self.high[:], self.used, self.held = 0, 0, 0
            self.pool = np.zeros(1 << 16, np.uint32)
        padded = np.frombuffer(data + bytes(16), np.uint8)
        key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 16)[start]).view("<u8")
        short = size <= _KEY
        fit = np.minimum(size, _KEY)
        low, high = key[:, 0] & _HEAD[fit], key[:, 1] & _TAIL[fit] | (fit.astype(np.uint64) << U64(56))
        slot = self._slot(low, high)
        hit = (self.low[slot] == low) & (self.high[slot] == high) & short
        other = np.flatnonzero(~hit)
        slot[other] ^= 1
        hit[other] = (self.low[slot[other]] == low[other]) & (self.high[slot[other]] == high[other]) & short[other]
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        miss = other[~hit[other]]
        if len(miss):
            found = [data[s:e] for s, e in zip(start[miss].tolist(), (start[miss] + size[miss]).tolist())]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(x, len(number)) for x in found], np.int64)
            placed, count = self._keep(self.solve([x.decode() for x in number]))
            at[miss], n[miss] = placed[which], count[which]
            new = miss[np.unique(which, return_index=True)[1]]
            new = new[short[new] & (n[new] < 256)]
            self._room(len(new))
            self._enter(low[new], high[new], at[new], n[new])
        ends = np.cumsum(n)
        return self.pool[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


_HEAD = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_KEY + 1)], np.uint64)
_TAIL = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_KEY + 1)], np.uint64)


def _pieces(texts: list[str], spaces: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and size of their pieces, and the pieces before each text and in all.

    Cuts are where both pre-tokenizers cut whatever stands around: between ASCII letters, digits and marks other than
    the apostrophe, around a line break, and before a space. Without ``spaces``, spaces and line breaks are left out.
    """
    raw = [t.encode() for t in texts]
    data = b"".join(raw)
    begin = np.cumsum([0, *map(len, raw)])
    kind = np.frombuffer(data.translate(_CLASS), np.uint8)
    cut = np.zeros(len(data) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (a != b) & (a > 0) & (b > 0) & ((a != _SPACE) | (not spaces)) if len(data) else False
    blank = kind >= (_BREAK if spaces else _SPACE)
    cut[:-1] |= kind >= _SPACE
    cut[1:] |= blank
    cut[begin] = True
    start = np.flatnonzero(cut[:-1])
    size = np.diff(np.r_[start, len(data)])
    if not spaces:
        words = ~blank[start]
        start, size = start[words], size[words]
    return data, start, size, np.searchsorted(start, begin)


class Pieces:
    """Vocabulary that encodes texts by their pieces, each distinct piece once for long."""

    spaces = True

    def __init__(self, path: str):
        self.path = path
        self.added, self.largest = _added(path)
        self.marked = _library(path)
        self.table = PieceTable(self.solve)

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        return _pieces(texts, self.spaces)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for run in slices(texts):
            how = [self.otherwise(t) for t in run]
            data, start, size, before = self.cut(["" if other else t for t, other in zip(run, how)])
            ids, n = self.table.ids(data, start, size)
            ends = (4 * np.r_[0, np.cumsum(n)][before]).tolist()
            raw = ids.astype("<u4").tobytes()
            for t, other, a, b in zip(run, how, ends, ends[1:]):
                out += other([t]) if other else [raw[a:b]]
        return out


class ByteLevel(Pieces):
    """Byte-level vocabulary: a word is encoded with the space before it."""

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if not t.startswith("<|")}
        self.bpe = tiktoken.Encoding(
            "from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.first = {c: np.zeros(max(ranks.values()) + 1, bool) for c in " \n"}
        for c, first in self.first.items():
            first[[i for t, i in ranks.items() if t[:1] == c.encode()]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [packed(self.bpe.encode_ordinary(t)) for t in texts]

    def otherwise(self, text: str) -> Callable | None:
        """How to encode a text that must not be cut."""
        return self.marked if self.added.search(text) else self.whole if _white_run(text) else None

    def _joined(self, pieces: list[str], before: str) -> list[bytes]:
        """Pieces with this character before them, encoded by one call and told apart by the ids that begin with it."""
        ids = np.array(self.bpe.encode_ordinary(before + before.join(pieces)), np.int64)
        return _runs(ids, self.first[before][ids], len(pieces)) or self.whole([before + p for p in pieces])

    def solve(self, pieces: list[str]) -> list[bytes]:
        spaced = [p for p in pieces if p[0] == " " and not p[-1].isspace()]
        bare = [p for p in pieces if not p[0].isspace() and not p[-1].isspace()]
        found = dict(zip(spaced, self._joined([p[1:] for p in spaced], " "))) if spaced else {}
        if bare:  # the line break is an id of its own
            found |= zip(bare, [x[4:] for x in self._joined(bare, "\n")])
        return [found[p] if p in found else self.whole([p])[0] for p in pieces]


class WordLevel(Pieces):
    """Vocabulary of words with an end mark; white space is dropped."""

    spaces = False

    def __init__(self, path: str):
        super().__init__(path)
        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        self.last = np.zeros(max(self.largest, *vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """With small letters, as the vocabulary has no others. A capital before a mark stays, as it may first join that."""
        data, *rest = _pieces(texts, self.spaces)
        small = data.lower()  # ASCII letters alone
        if not data.isascii():
            raw = np.frombuffer(data, np.uint8)
            changed = np.frombuffer(small, np.uint8).copy()
            stay = np.flatnonzero((raw[1:] > 127) & (changed[:-1] != raw[:-1]))
            changed[stay] = raw[stay]
            small = changed.tobytes()
        return small, *rest

    def otherwise(self, text: str) -> Callable | None:
        return self.marked if self.added.search(text) else None

    def _words(self, words: list[str], library: Callable[[str], Tokenizer]) -> list[bytes]:
        """Runs of letters, joined for a call and told apart by the ids that end a word."""
        out = []
        joined = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        made = library(self.path).encode_batch_fast([" ".join(w) for w in joined], add_special_tokens=False)
        for some, e in zip(joined, made):
            ids = np.array(e.ids, np.int64)
            out += _runs(ids, np.r_[True, self.last[ids][:-1]], len(some)) or self.marked(some)
        return out

    def solve(self, pieces: list[str]) -> list[bytes]:
        cut = []
        for p in pieces:
            if p.isalpha():
                cut.append((p, ""))
                continue
            m = _WORD_AND_MARKS.fullmatch(p)
            # In lower case a word may end in a mark (U+0130 does), which the library joins to the marks behind it.
            cut.append(m.groups() if m and m[1].isalpha() and m[1].lower().isalpha() else ("", p))
        words = {w for w, _ in cut if w}
        other = list({o for _, o in cut if o})
        found = {"": b""}
        plain = {w for w in words if _PLAIN.fullmatch(w)}
        for some, library in ((list(plain), plain_tokenizer), (list(words - plain), tokenizer)):
            found.update(zip(some, self._words(some, library)))
        rest = dict(zip(other, self.marked(other))) | {"": b""}
        return [found[w] + rest[o] for w, o in cut]


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=4)
def word_level(path: str) -> WordLevel:
    return WordLevel(path)
