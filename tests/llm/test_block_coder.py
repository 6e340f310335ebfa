"""The coder of token blocks: intervals tile their whole, and ids of any size and number come back."""

import os
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from haulmark.llm import token_blocks
from haulmark.llm.byte_tokens import tokenizer


@pytest.mark.parametrize("alphabet", [1, 10, 49_408, 300_000])
def test_ids_come_back(alphabet):
    rng = np.random.default_rng(alphabet)
    kinds = [lambda n: rng.integers(0, alphabet, n), lambda n: np.full(n, alphabet - 1), lambda n: np.minimum(rng.zipf(1.4, n), alphabet) - 1]
    kinds.append(lambda n: np.resize(rng.integers(0, alphabet, 37), n))
    for n in (1, 2, 255, 256, 257, 511, 513, 5_000, 70_001):
        for kind in kinds:
            ids = kind(n).astype("<u4")
            coded = token_blocks.code(ids, alphabet)
            assert np.array_equal(token_blocks.decode(coded, n, alphabet), ids)


def test_intervals_of_all_ids_tile_a_power_of_two():
    alphabet, rng = 500, np.random.default_rng(2)
    model = token_blocks.Mixer(alphabet)
    one, two = np.zeros(64, np.uint32), np.zeros(64, np.uint32)
    for _ in range(40):
        model.predict(one, two)
        now = np.where(rng.random(64) < 0.6, one // 2 + 1, rng.integers(0, alphabet, 64)).astype(np.uint32)
        model.interval(now)
        model.update(now)
        one, two = now, one
    model.predict(one, two)
    whole = 1 << int(model.bits)
    total, p1, p2 = np.zeros(64, object), model.p1.copy(), model.p2.copy()
    for i in range(alphabet):
        begin, size = model.interval(np.full(64, i, np.uint32))
        assert (size > 0).all() and (begin + size <= whole).all()
        for place in (begin, begin + size - np.uint64(1)):
            assert (model.find(place) == i).all()
        # A predicted id also has a place of its own among all, which is never used.
        unused = (np.uint64(1 << 12) - model.f2) * model.size[i]
        total += size.astype(object) + np.where((p1 == i) | (p2 == i), unused, 0).astype(object)
    assert (total == whole).all()


def test_the_library_keeps_to_the_core_of_its_task():
    tokenizer.cache_clear()
    os.environ.pop("TOKENIZERS_PARALLELISM", None)
    tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_a_full_block_is_coded_in_few_steps_and_little_memory():
    n = token_blocks.BLOCK_IDS
    lanes, steps = token_blocks._layout(n)
    assert lanes >= 8192 and steps <= 512  # a step of few lanes is mostly the cost of its calls
    ids = np.minimum(np.random.default_rng(3).zipf(1.4, n), 49_408).astype("<u4") - np.uint32(1)
    tracemalloc.start()
    block = token_blocks.write_block([1, 2], [n - 5, 5], ids.tobytes(), 49_408)
    written = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    docs, lengths, got = token_blocks.read_block(block)
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert docs == [1, 2] and lengths == [n - 5, 5] and got == ids.tobytes()
    assert written < 100e6 and read < 100e6


def test_lanes_of_very_different_lengths():
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.zeros(40 * 600), rng.integers(0, 300_000, 600), np.zeros(3 * 600 - 7)]).astype("<u4")
    coded = token_blocks.code(ids, 300_000)
    assert np.array_equal(token_blocks.decode(coded, len(ids), 300_000), ids)
    assert max(map(len, coded)) > 50 * min(map(len, coded))


@pytest.mark.parametrize("layout", [(2048, 256), (7, 10), (1, 1)])
def test_blocks_of_another_layout_are_read(monkeypatch, layout):
    blocks = {}
    with monkeypatch.context() as m:
        m.setattr(token_blocks, "MOST_LANES", layout[0])
        m.setattr(token_blocks, "LANE_IDS", layout[1])
        for n in (1, 2, 17, 600, 1001, 5000):
            ids = (np.arange(n) ** 2 % 97).astype("<u4").tobytes()
            blocks[n] = ids, token_blocks.write_block([3], [n], ids, 97)
    for n, (ids, block) in blocks.items():
        assert token_blocks.read_block(block) == ([3], [n], ids)


def test_a_block_is_handed_on_in_parts():
    n = 2 * token_blocks.BATCH_ROWS + 1
    lengths = [1 + i % 3 for i in range(n)]
    ids = np.arange(sum(lengths), dtype="<u4") % 10
    block = token_blocks.write_block([*range(n - 1), None], lengths, ids.tobytes(), 10)
    files = pa.RecordBatch.from_arrays([pa.array([100]), pa.array([block])], names=["before", "data"])
    parts = list(token_blocks._read(iter([files])))
    assert [p.num_rows for p in parts] == [token_blocks.BATCH_ROWS] * 2 + [1]
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(n - 1), None]
    assert [r["start"] for r in rows] == (100 + np.cumsum([0, *lengths[:-1]])).tolist()
    assert b"".join(r["ids"] for r in rows) == ids.tobytes() and [len(r["ids"]) // 4 for r in rows] == lengths
