"""SentencePiece ids and decoding with a table of distinct marked words.

If no piece has a white-space marker behind another character, merges never cross the start of a marked word (a run of
markers and what follows up to the next marker). Every distinct marked word is then segmented once per worker, by the
library itself, and ids are joined back by position. Models for which this does not hold, and texts with other than
lone spaces, go to the library whole. Decoding always goes through the library's ``decode`` on the joined ids.

Nulls: a null text is empty and gives the begin and end id. Other columns are ignored; rows are treated one by one, so
ties and repeated rows need no rule, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from haulmark.llm.byte_tokens import TABLE, packed
from haulmark.llm.common import ChunkTable, slices, texts_of

MARK = "▁"


class PieceCodec:
    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        probe = "a  b"  # cutting also needs a dummy prefix and white space kept as it is
        self.cuts = (
            not any(MARK in p.lstrip(MARK) for p in pieces)
            and m.encode("a", out_type=str)[0].startswith(MARK)
            and m.decode(m.encode(probe)) == probe
        )
        # A character that is in no longer piece is a piece boundary on both sides.
        self.newline_cuts = self.cuts and not any("\n" in p for p in pieces) and len(m.encode("\n")) == 2
        self.newline = packed(m.encode("\n")[1:]) if self.newline_cuts else b""
        self.begin, self.end = packed([m.bos_id()]), packed([m.eos_id()])
        self.words = ChunkTable(self._words, TABLE)
        self.inner = ChunkTable(self._inner, TABLE // 4)

    def _words(self, chunks: list[str]) -> list[bytes]:
        """A chunk stands for marker + chunk. Behind a newline no marker precedes."""
        if not self.newline_cuts:
            return [packed(x) for x in self.model.encode(chunks, num_threads=1)]
        cut = [c.split("\n") for c in chunks]
        heads = [packed(x) if c[0] else self.lone for x, c in zip(self.model.encode([c[0] for c in cut], num_threads=1), cut)]
        self.inner.fill({p for c in cut for p in c[1:]})
        return [
            h + b"".join([self.newline + self.inner[p] for p in c[1:]]) for h, c in zip(heads, cut)
        ]

    def _inner(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without a marker: encoded behind a newline, which is cut off with the dummy prefix."""
        return [packed(x[2:]) for x in self.model.encode(["\n" + c for c in chunks], num_threads=1)]

    @property
    def lone(self) -> bytes:
        return packed([self.model.piece_to_id(MARK)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end id, as little-endian 32-bit integers."""
        out = []
        for run in slices(texts):
            plain = [self.cuts and bool(t) and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " and "\0" not in t for t in run]
            cut = [t.split(" ") if p else [] for t, p in zip(run, plain)]
            self.words.fill(set().union(*cut))
            get = self.words.__getitem__
            for t, p, c in zip(run, plain, cut):
                body = b"".join(map(get, c)) if p else packed(self.model.encode(t))
                out.append(self.begin + body + self.end)
        return out

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _round_trip(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            doc_ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some in slices(texts, 1_000_000):
                ids = pieces.encode(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[at : at + len(some)], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([pieces.decode(x) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )
                at += len(some)

    return run


def piece_round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 32 bit, with begin and end id) and the text decoded from them."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return texts_of(docs).mapInArrow(_round_trip(path), "doc_id long, ids binary, decoded string")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr(
        "doc_id",
        "cast(octet_length(ids) div 4 as long) AS n_tokens",
        "sha2(ids, 256) AS ids_sha256",
        "sha2(cast(decoded AS binary), 256) AS decoded_sha256",
    )
