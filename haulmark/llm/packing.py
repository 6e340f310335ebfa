"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

A document is its ids and an end id. It is cut into full windows, which stand alone, and a rest in pieces of at most
``PIECE`` ids. The pieces are spread by a hash over blocks that are filled by about ``BLOCK`` windows each. In a block
every piece starts as a partial partition of its own; the two with the largest imbalance are merged, the fullest slot
of one onto the emptiest of the other, until one near-equal partition is left. Where a window exceeds the capacity,
the block gets a window more and is partitioned anew. Blocks are of bounded size whatever the table, and no group
holds one document or source only.

Nulls: a null text is empty; an empty document is its end id alone. Repeated rows and null ids are packed like any
row. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.byte_tokens import byte_level
from haulmark.llm.common import keep, partitions, releasing, releasing_group, slices, texts_of

WINDOW, PIECE, BLOCK = 1024, 256, 96
_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    full = n - n % window
    return [(s, window) for s in range(0, full, window)] + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def _tokenize(path: str, window: int, piece: int, end_id: int) -> Callable:
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level(path).encode
        for batch in batches:
            doc_ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some in slices(texts, 1_000_000):
                rows = []
                for doc, ids in zip(doc_ids[at : at + len(some)], encode(some)):
                    ids += tail
                    n = len(ids) // 4
                    rows += [(doc, s, k, n, ids[4 * s : 4 * (s + k)]) for s, k in cuts(n, window, piece)]
                at += len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The slot (0 ... k-1) of every size, such that the slots' sums are nearly equal."""
    n = len(sizes)
    values = {}
    parts: dict[int, tuple[int, int, np.ndarray]] = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        v = np.zeros(k, np.int64)
        v[0] = size
        values[i] = v
        heap.append((-size, i))
    heapq.heapify(heap)
    top = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        v = values.pop(a) + values.pop(b)[::-1]
        order = (-v).argsort(kind="stable")
        v = v[order]
        v -= v[-1]
        values[top], parts[top] = v, (a, b, order)
        heapq.heappush(heap, (-int(v[0]), top))
        top += 1
    slots = np.zeros(n, np.int64)
    open_ = {heap[0][1]: np.arange(k)}
    while open_:
        node, where = open_.popitem()
        if node < n:
            slots[node] = where[0]
            continue
        a, b, order = parts[node]
        left = np.empty(k, np.int64)
        left[order] = where
        open_[a], open_[b] = left, left[::-1]
    return slots


def partition(sizes: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """Slots for pieces such that none exceeds the window, and how many slots there are."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        slots = differencing(sizes, k)
        if np.bincount(slots, sizes, k).max() <= window:
            return slots, k
        k += 1


def _place(window: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        sizes = block["length"].to_numpy()
        full = sizes == window
        slots = np.empty(len(block), np.int64)
        slots[full] = np.arange(full.sum())
        if (~full).any():
            slots[~full] = partition(sizes[~full], window)[0] + full.sum()
        order = np.argsort(slots, kind="stable")
        run_up = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, slots[order][1:] != slots[order][:-1]]
        offset = np.empty(len(block), np.int64)
        offset[order] = run_up - np.maximum.accumulate(np.where(first, run_up, 0))
        block["sequence_id"] = block["block"].to_numpy() * (1 << 32) + slots
        block["offset"] = offset
        return block.drop(columns="block")

    return run


def pieces_of(
    docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, piece: int = PIECE
) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (binary, little-endian 32 bit) of every piece, in shared files."""
    return keep(texts_of(docs).mapInArrow(releasing(_tokenize(tokenizer_path, window, piece, end_id)), _PIECES), "pack-pieces")


def plan(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Where each piece goes: its sequence and offset, and the CRC of its ids."""
    load = pieces.where(F.col("length") < window).agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-load // (block * window)))
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).alias("block")
    return (
        pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
        .select("*", spread)
        .repartition(min(blocks, 4 * partitions(pieces)), "block")
        .groupBy("block")
        .applyInPandas(releasing_group(_place(window)), _PLACED)
    )


def sequences(pieces: DataFrame, placed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids padded to the window; a length that is a power of two stays as it is.

    ``pieces`` and ``placed`` belong together; doc_id and start must name a piece uniquely here.
    """
    joined = placed.select("doc_id", "start", "sequence_id", "offset").join(pieces, ["doc_id", "start"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = joined.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))

    def pad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                filled = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int64)
                short = 0 if n & (n - 1) == 0 else window - n
                ids.append(np.pad(filled, (0, short), constant_values=pad_id).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int64()))],
                names=["sequence_id", "length", "ids"],
            )

    return whole.mapInArrow(pad, "sequence_id long, length long, ids array<long>")


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return plan(pieces_of(docs, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
