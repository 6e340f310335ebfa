"""What a Python worker holds while it works and while it waits: all workers of an executor share its memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from haulmark.llm import common, exact_dedup, jaccard_join, packing, suffix_dedup, toxicity
from haulmark.llm.byte_tokens import PieceTable, _pieces


def test_inverted_lists_of_a_large_group_are_read_in_parts():
    sets = [np.r_[np.arange(100, dtype=np.uint64), np.uint64(1000 + i // 2), np.uint64(10_000 + i)] for i in range(2000)]
    lists = jaccard_join.Inverted(sets)
    tracemalloc.start()
    got = lists.overlaps(2, 66)  # 12.8 million entries
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    left, right = np.arange(2, 66)[:, None], np.arange(2000)[None, :]
    assert (got == 100 + (left // 2 == right // 2)).all()  # what one set has alone is in no list
    assert peak < 60e6


def test_inverted_lists_against_brute_force():
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40))).astype(np.uint64) for _ in range(50)]
    often = np.bincount(np.concatenate(sets).astype(int))
    shared = [set(x[often[x.astype(int)] > 1].tolist()) for x in sets]
    want = [[len(a & b) for b in shared] for a in shared]
    assert np.vstack([jaccard_join.Inverted(sets).overlaps(s, min(s + 7, 50)) for s in range(0, 50, 7)]).tolist() == want
    assert jaccard_join.Inverted([np.array([4, 5], np.uint64)]).overlaps(0, 1).tolist() == [[0]]


def test_the_table_of_pieces_grows_with_what_it_holds():
    asked = []
    solve = lambda pieces: (asked.extend(pieces), [np.frombuffer(p.encode(), np.uint8).astype("<u4").tobytes() for p in pieces])[1]
    table = PieceTable(solve)
    held = lambda: sum(x.nbytes for x in (table.low, table.high, table.at, table.n))

    def encode(text):
        data, start, size, _ = _pieces([text], True)
        assert table.ids(data, start, size)[0].tolist() == list(text.encode())

    encode("a few words")
    assert held() < 2e6
    text = " ".join(f"w{i}" for i in range(150_000))
    for part in (text[:300_000], text, text):
        asked.clear()
        encode(part)
    assert 2 * 100_000 < table.slots <= table.limit and len(asked) < 40_000
    assert table.held == (table.high > 0).sum()


def test_workers_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.releasing(lambda x: (y + 1 for y in x))(iter([1, 2]))) == [2, 3] and calls == [1]
    assert common.releasing_group(lambda x: x + 1)(1) == 2 and calls == [1, 1]


@pytest.mark.parametrize("module", [exact_dedup, jaccard_join, packing, suffix_dedup, toxicity])
def test_all_work_of_the_pipeline_gives_memory_back(module):
    source = open(module.__file__, encoding="utf-8").read().replace("\n", " ").replace(" ", "")
    assert source.count("mapInArrow(") == source.count("mapInArrow(releasing(") + (module is packing)  # sequences() is no part of it
    assert source.count("applyInPandas(") == source.count("applyInPandas(releasing_group(")


def test_long_texts_are_cut_into_sets_a_run_at_a_time():
    texts = [" ".join(f"w{(i * 7919 + j * j) % 9973}" for j in range(20_000)) for i in range(60)]  # 7 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    n = [x for b in jaccard_join._describe(3)(iter([batch])) for x in b.column(1).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == [len(set(zip(w, w[1:], w[2:]))) for w in map(str.split, texts)]
    assert peak < 150e6
