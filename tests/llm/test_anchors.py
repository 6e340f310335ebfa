"""Anchors against a plain search for them, and what they take."""

import tracemalloc

import numpy as np

from haulmark.llm import suffix_dedup
from haulmark.llm.common import gram_hashes, mix, prefix_hash, span_hash


def _plain(data: bytes, offsets: list[int], span: int, gram: int) -> list[tuple]:
    """(place, first string, number of strings, text) of each stretch."""
    prefix = prefix_hash(np.frombuffer(data, np.uint8))
    rank = lambda i: (int(mix(span_hash(prefix, np.array([i]), np.array([i + gram])), 3)[0]) >> 32, i)
    out = []
    for d, (a, b) in enumerate(zip(offsets, offsets[1:])):
        for i in range(a, b - span + 1):
            place = min(map(rank, range(i, i + span - gram + 1)))[1]
            if i > a and out[-1][0] == place:
                out[-1] = (place, out[-1][1], out[-1][2] + 1, d)
            else:
                out.append((place, i, 1, d))
    return out


def test_anchors_equal_a_plain_search():
    rng = np.random.default_rng(5)
    for case in range(60):
        sizes = rng.integers(0, [4, 30, 90][case % 3], rng.integers(0, 9))
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        data = rng.integers(97, 97 + [1, 2, 26][case % 7 % 3], offsets[-1]).astype(np.uint8)
        for span, gram in ((20, 8), (9, 8), (50, 24)):
            h, place, start, count, doc, prefix = suffix_dedup.anchors(data, offsets, span, gram)
            assert list(zip(place.tolist(), start.tolist(), count.tolist(), doc.tolist())) == _plain(data.tobytes(), offsets.tolist(), span, gram)
            assert np.array_equal(h, mix(span_hash(prefix, place, place + gram), 3))


def test_hashes_of_all_grams_are_those_of_spans():
    prefix = prefix_hash(np.random.default_rng(1).integers(0, 256, 500).astype(np.uint8))
    at = np.arange(500 - 24 + 1)
    assert np.array_equal(gram_hashes(prefix, 24), span_hash(prefix, at, at + 24))


def test_anchors_hold_few_arrays_of_all_bytes():
    data = np.random.default_rng(2).integers(0, 256, 1 << 20).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, 1 << 12)
    suffix_dedup.anchors(data, offsets)  # the powers stay
    tracemalloc.start()
    suffix_dedup.anchors(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(data), peak / len(data)
