"""Packed rows: their number does not follow the runs of texts, and what is in them is what the plain versions give."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from haulmark.llm import suffix_dedup
from haulmark.llm.packed import as_frame, pack_by_bucket, unpack


def batches_of(n: int, docs: int = 3) -> list[pa.RecordBatch]:
    rng = np.random.default_rng(n)
    out = []
    for i in range(n):
        texts = ["".join(rng.choice(list("abcdefghijklmnop "), 400)) + " a passage that all of these documents share" for _ in range(docs)]
        ids = pa.array(range(i * docs, (i + 1) * docs), pa.int64())
        out.append(pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["doc", "print", "text"]))
    return out


def test_rows_of_the_deal_do_not_follow_the_runs():
    """A run of texts has some anchors for every bucket; with a row for each, rows grow as runs times buckets."""
    buckets = 16
    few, many = (sum(b.num_rows for b in suffix_dedup._deal(buckets)(iter(batches_of(n)))) for n in (40, 80))
    assert many <= 2 * buckets
    assert few >= buckets  # each of them has rows already


def test_contexts_of_a_bucket_are_one_row():
    batch = batches_of(1, 200)[0]
    start = [np.array([0, 7, 30], "<u4").tobytes()] * 200
    columns = {
        "anchor": [np.array([5, 1 << 63, i], "<u8").tobytes() for i in range(200)],
        "start": start,
        "strings": [bytes([1, 2, 27])] * 200,
        "further": [np.array([0, 2, 1], "<u4").tobytes()] * 200,
        "further_prints": [np.array([i, -i, 9], "<i8").tobytes() for i in range(200)],
        "further_starts": [np.array([3, 4, i], "<u4").tobytes() for i in range(200)],
    }
    given = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in columns.values())], names=["doc", "print", "text", *columns])
    buckets = 4
    rows = [b for b in suffix_dedup._contexts(buckets)(iter([given.slice(0, 90), given.slice(90)]))]
    assert sum(b.num_rows for b in rows) <= buckets
    frame = pd.concat([b.to_pandas() for b in rows])
    docs, prints, anchor, at, strings, further = unpack(frame, {"anchor": "<u8", "start": "<u4", "strings": "<u1", "further": "<u4"})
    raw, other = b"".join(frame["bytes"]), np.frombuffer(b"".join(frame["further_prints"]), "<i8")
    texts, got, want = batch.column(2).to_pylist(), [], []
    b = f = 0
    for d, p, a, s, n, more in zip(docs.tolist(), prints.tolist(), anchor.tolist(), at.tolist(), strings.tolist(), further.tolist()):
        got.append((d, p, a, raw[b : b + n + 49], tuple(other[f : f + more].tolist())))
        b, f = b + n + 49, f + more
    for i in range(200):
        for a, s, n, more in ((5, 0, 1, ()), (1 << 63, 7, 2, (i, -i)), (i, 30, 27, (9,))):
            want.append((i, i, a, texts[i][s : s + n + 49].encode(), more))
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("far, ordered", [(0, True), (0, False), (1 << 20, True)])
def test_packed_rows_hold_the_entries(far, ordered):
    rng = np.random.default_rng(5)
    n = 500
    bucket, owner = rng.integers(0, 7, n) + far, rng.integers(0, 20, n)
    owner = np.sort(owner) if ordered else owner
    ids, prints = rng.integers(-(1 << 60), 1 << 60, 20), rng.integers(-(1 << 60), 1 << 60, 20)
    value, many = rng.integers(0, 255, n).astype("<u1"), rng.integers(0, 4, n)
    items = rng.integers(0, 1 << 30, many.sum()).astype("<i8")
    frame = as_frame(pack_by_bucket(bucket, owner, ids, prints, {"v": value}, {"x": (items, np.cumsum(many) - many, many)}))
    assert frame["bucket"].tolist() == sorted(set(bucket.tolist()))
    for row in frame.itertuples():
        mine = np.flatnonzero(bucket == row.bucket)
        mine = mine[np.argsort(owner[mine], kind="stable")]
        docs, marks, v = unpack(pd.DataFrame([row]), {"v": "<u1"})
        assert docs.tolist() == ids[owner[mine]].tolist() and marks.tolist() == prints[owner[mine]].tolist()
        assert v.tolist() == value[mine].tolist()
        first = np.cumsum(many) - many
        assert np.frombuffer(row.x, "<i8").tolist() == [x for i in mine for x in items[first[i] : first[i] + many[i]].tolist()]


def test_documents_with_the_same_key_stay_apart(monkeypatch):
    docs, prints = np.array([3, 1, 3, 1, 2, 1]), np.array([0, 0, 0, 9, 0, 0])
    for key in (suffix_dedup._document_key, lambda d, p: np.zeros(len(d), np.uint64)):
        monkeypatch.setattr(suffix_dedup, "_document_key", key)
        order, cut = suffix_dedup._by_document(docs, prints)
        groups = [{(int(docs[i]), int(prints[i])) for i in order[s:e]} for s, e in zip(cut, cut[1:])]
        assert all(len(g) == 1 for g in groups)
        assert sorted(g.pop() for g in groups) == [(1, 0), (1, 9), (2, 0), (3, 0)]
    order, cut = suffix_dedup._by_document(docs[:0], prints[:0])
    assert len(order) == 0 and cut.tolist() == [0]


def test_order_of_stretches():
    rng = np.random.default_rng(6)
    for n in (0, 1, 4000):
        docs, prints, start = rng.integers(-3, 4, n), rng.integers(-2, 2, n), rng.integers(0, 4, n).astype("<u4")
        anchor, body = rng.integers(0, 9, n).astype(np.uint64) << np.uint64(60), rng.integers(0, 5, n).astype(np.uint64)
        order = suffix_dedup._by_stretch(docs, prints, anchor, body, start)
        plain = np.lexsort((start, prints, docs, body, anchor))
        for x in (docs, prints, anchor, body, start):
            assert x[order].tolist() == x[plain].tolist()


def test_cut_out_of_many_texts():
    texts = [b"", b"a" * 120, b"b" * 70, b"", b"c" * 300, b""]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    stretches = [(1, 0, 2), (1, 69, 2), (2, 0, 21), (4, 10, 1), (4, 10, 1), (4, 59, 3), (4, 200, 51)]
    owner, start, strings = (np.array(x) for x in zip(*stretches))
    kept, removed, runs = suffix_dedup.cut_out(np.frombuffer(b"".join(texts), np.uint8), offsets, owner, start, strings)
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for o, s, n in stretches:
            if o == i:
                gone[s : s + n + 49] = b"\1" * (n + 49)
        assert kept[i].as_py() == bytes(c for c, g in zip(t, gone) if not g)
        assert (removed[i], runs[i]) == (sum(gone), len([r for r in bytes(gone).split(b"\0") if r]))


def test_equal_suffixes_are_compared_once(monkeypatch):
    """The context of a passage that very many documents have, as at its edge: most of its strings are the same."""
    rng = np.random.default_rng(8)
    own = rng.integers(97, 123, (2_000, 40)).astype(np.uint8)
    data = np.hstack([np.tile(rng.integers(97, 123, 62).astype(np.uint8), (2_000, 1)), own]).ravel()
    at = (np.arange(2_000)[:, None] * 102 + np.arange(16)).ravel()
    suffixes, compared = suffix_dedup.Suffixes(data), []
    less = suffixes.less
    monkeypatch.setattr(suffixes, "less", lambda x, *a: compared.append(len(x)) or less(x, *a))
    order, run = suffixes.runs(at, np.zeros(len(at), np.int64))
    keys = [data[x : x + 50].tobytes() for x in at[order]]
    assert keys == sorted(keys)
    assert all((a == b) == (i == j) for a, b, i, j in zip(keys, keys[1:], run, run[1:]))
    assert sum(compared) < 20 * len(at)  # 107 for each before
