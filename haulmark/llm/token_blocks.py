"""Token ids as files of independent, checksummed blocks, coded by an adaptive context-mixing range coder.

A block holds the ids of whole documents, about ``BLOCK_IDS`` of them, and is reset at its start. Its ids are laid out
in lanes that are coded side by side; all lanes learn one model. The contexts of one and of two ids before each predict
an id, with a confidence that grows when the prediction comes true. How much probability the order-2 prediction, the
order-1 prediction and the order-0 frequencies get is learned for every pair of confidences. The mixture drives a
carry-less 64-bit range coder, which sends 16 bits of a lane at a time. Weights and frequencies are scaled to powers of
two, so an interval costs no division; frequencies are counted anew after ever more steps.

Files are Parquet tables of blocks, written by Spark to the shared folder in ascending order of ``doc_id``; a row is
one block, whose bytes are complete in themselves: header, checksums of the coded bytes and of the ids, document ids
and lengths, coded lanes.

Nulls: a null text is empty, which gives the end id alone. A null ``doc_id`` comes behind all others and is kept. Rows
with equal ids follow each other by a hash of their texts; repeated rows are written as often as they occur. An empty
table gives no blocks and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.byte_tokens import word_level
from haulmark.llm.common import BATCH_ROWS, U64, keep, partitions, releasing, slices, texts_of

BLOCK_IDS = 1 << 22
MOST_LANES, LANE_IDS = 8192, 512
_BOTTOM = U64(1 << 48)
_WEIGHT = 12  # bits of the weights
_WHOLE = U64(1 << _WEIGHT)
_ONE, _THREE, _FOUR, _SEVEN, _EIGHT = (np.uint32(x) for x in (1, 3, 4, 7, 8))
_LOW, _MIX1, _MIX2, _DROP = (np.uint32(x) for x in (0xFFFF, 0x9E3779B1, 0x61725DC0, 14))
_SHIFT, _TOP, _HALF, _LOWER = U64(16), U64(48), U64(32), U64(0xFFFFFFFF)


def _outcomes() -> tuple[np.ndarray, np.ndarray]:
    """What follows from each of 512 outcomes of a step: the slot of the weights it counts for (of three times 128), and
    what changes in the entries of the contexts of one and of two ids.

    An outcome has, from the lowest bit: whether both predictions are equal, the confidence of the order-1 entry, whether
    its prediction failed, and the same two of the order-2 entry.
    """
    v = np.arange(512)
    same, k1, wrong1, k2, wrong2 = v & 1, v >> 1 & 7, v >> 4 & 1, v >> 5 & 7, v >> 8
    slot = np.where(wrong2, 1 + wrong1, 0) * 128 + (k2 * 8 + k1) * 2 + same
    changes = []
    for k, wrong in ((k1, wrong1), (k2, wrong2)):
        kept = k ^ np.where(wrong, k >> 1, np.minimum(k + 1, 7))
        changes.append(np.where(wrong & (k == 0), 0xFFFFFFF9, kept).astype(np.uint32))  # all of the id, confidence one
    return slot, np.stack(changes)


_SLOT, _CHANGE = _outcomes()
_REFRESH = {1, 2, 4, 8, 16, 32, 48, 64, 96}  # steps after which frequencies are counted anew, besides every 128th
_MAGIC = b"IDB2"
_HEADER = struct.Struct("<4s6I")  # magic, ids, documents, lanes, alphabet, crc of the body, crc of the ids
_NULL = -(1 << 63)


class Mixer:
    """What coder and decoder know before each step; both make the same updates in the same order.

    An entry of a context is its predicted id, and in the lowest three bits the confidence. Weights and frequencies are
    scaled to powers of two, so that an interval is one out of ``2**bits``.
    """

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.places = max(20, alphabet.bit_length() + 2)
        self.bits = U64(self.places + _WEIGHT)
        self.contexts = [np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint32)]
        k2, k1, same = np.meshgrid(np.arange(8), np.arange(8), np.arange(2), indexing="ij")
        self.mix = np.stack([1 + 16 * k2, 1 + 8 * k1 * (1 - same), 24 + 0 * k2]).reshape(3, 128).astype(np.float64)
        self.apart = 1.0 - same.ravel()
        self.counts = np.ones(alphabet, np.int64)
        self.pending: list[np.ndarray] = []
        self.seen: list[np.ndarray] = []
        self.step = 0
        self._weigh()
        self._refresh()

    def _weigh(self) -> None:
        """Whole numbers throughout, held as floats, whose quotients are cut exactly."""
        if self.seen:
            often = np.bincount(np.concatenate(self.seen), minlength=512)
            self.mix += 4 * np.bincount(_SLOT, often, 384).reshape(3, 128)
            self.seen = []
        total = self.mix.sum(0)
        while (heavy := total > 1 << 16).any():
            self.mix[:, heavy] = np.floor((self.mix[:, heavy] + 1) / 2)
            total = self.mix.sum(0)
        first, second = 1 + np.floor(self.mix[:2] * ((1 << _WEIGHT) - 3) / total)
        shares = np.zeros((6, 128))  # where the shares of the predictions and of the rest begin, and what they are
        shares[1] = shares[3] = first
        shares[4] = second * self.apart
        shares[2] = first + shares[4]
        shares[5] = (1 << _WEIGHT) - shares[2]
        shares = shares.astype(np.uint64)
        self.first, self.second = shares[1], shares[2]
        self.lower = (shares[:3] << U64(self.places)).ravel()[_SLOT]
        self.share = shares[3:].ravel()[_SLOT]

    def _refresh(self) -> None:
        if self.pending:
            self.counts += 32 * np.bincount(np.concatenate(self.pending), minlength=self.alphabet)
            self.pending = []
        free = (1 << self.places) - self.alphabet
        size = 1 + (self.counts * (free / self.counts.sum())).astype(np.int64)
        size[self.counts.argmax()] += (1 << self.places) - size.sum()
        self.size = size.astype(np.uint64)
        # Begin and size in one, to be looked up at once. The last one is for predicted ids, which have all of their share.
        self.spans = np.r_[(np.cumsum(size) - size) << 32 | size, 1 << self.places].astype(np.uint64)
        self.holder = None

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """one, two: the last id and the last but one of every lane."""
        mixed = one * _MIX1
        mixed += two * _MIX2
        mixed >>= _DROP
        self.at = [(one & _LOW).astype(np.intp), mixed.astype(np.intp)]
        self.e1, self.e2 = (entries[at] for entries, at in zip(self.contexts, self.at))
        self.k1, self.k2 = self.e1 & _SEVEN, self.e2 & _SEVEN
        self.same = (self.e1 ^ self.e2) < _EIGHT

    @property
    def p1(self) -> np.ndarray:
        return self.e1 >> _THREE

    @property
    def p2(self) -> np.ndarray:
        return self.e2 >> _THREE

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) of the ids, out of ``2**bits``."""
        top = ids << _THREE
        self.x1, self.x2 = self.e1 ^ top, self.e2 ^ top  # the confidence alone where the prediction is right
        wrong1, wrong2 = np.minimum(self.x1, self.k1 | _EIGHT), np.minimum(self.x2, self.k2 | _EIGHT)
        at = np.where(np.minimum(wrong1, wrong2) < _EIGHT, np.uint32(self.alphabet), ids).astype(np.intp)
        wrong2 <<= _FOUR
        wrong2 |= wrong1
        wrong2 <<= _ONE
        self.outcome = wrong2.astype(np.intp)
        self.outcome += self.same
        size = self.spans[at]
        begin = size >> _HALF
        size &= _LOWER
        share = self.share[self.outcome]
        begin *= share
        begin += self.lower[self.outcome]
        size *= share
        return begin, size

    def find(self, place: np.ndarray) -> np.ndarray:
        """Ids whose intervals hold the places."""
        if self.holder is None:
            every = np.arange(self.alphabet, dtype=np.min_scalar_type(self.alphabet))
            self.holder = np.repeat(every, self.size.astype(np.int64))
        cell = self.k2 << _THREE
        cell |= self.k1
        cell <<= _ONE
        cell = cell.astype(np.intp)
        cell += self.same
        self.f2 = self.second[cell]
        part = place >> U64(self.places)
        ids = np.where(part < self.first[cell], self.p2, self.p1)
        rest = (part >= self.f2).nonzero()[0]
        f2 = self.f2[rest]
        # Below 2**53, and over less than 2**12, so that the quotient is never rounded to a whole number above it.
        inside = (place[rest] - (f2 << U64(self.places))).astype(np.float64)
        inside /= _WHOLE - f2
        ids[rest] = self.holder[inside.astype(np.int64)]
        return ids

    def update(self, ids: np.ndarray) -> None:
        self.seen.append(self.outcome)
        for entries, at, entry, x, change in zip(
            self.contexts, self.at, (self.e1, self.e2), (self.x1, self.x2), _CHANGE
        ):
            x |= _SEVEN
            x &= change[self.outcome]
            x ^= entry
            entries[at] = x  # where lanes share a context, the last one's view is kept
        self.pending.append(ids)
        self.step += 1
        if self.step < 16 or self.step % 4 == 0:
            self._weigh()
        if self.step in _REFRESH or self.step % 128 == 0:
            self._refresh()


def _layout(n: int) -> tuple[int, int]:
    """Lanes and ids in each (the last lanes may hold less)."""
    lanes = max(1, min(MOST_LANES, n // LANE_IDS))
    each = -(-n // lanes)
    return -(-n // each), each


def _shrunk(low: np.ndarray, size: np.ndarray, ready: np.ndarray) -> np.ndarray:
    """Make 16 bits of room in the ready lanes; where these bits are not settled, the interval is cut so that they are.

    Returns the bits by which each lane moved.
    """
    crosses = (low ^ (low + size)) >= _BOTTOM
    crosses &= ready
    cut = crosses.nonzero()[0]
    if len(cut):
        size[cut] = (~low[cut] + U64(1)) & (_BOTTOM - U64(1))
    by = ready.astype(np.uint64)
    by <<= U64(4)
    low <<= by
    size <<= by
    return by


class Sent:
    """What the lanes have sent, 16 bits at a time."""

    def __init__(self, lanes: int, width: int):
        self.rows, self.most = np.zeros((lanes, width), np.uint16), 0
        self.at = np.arange(lanes) * width  # the next free place of each lane

    def begins(self) -> np.ndarray:
        return np.arange(len(self.rows)) * self.rows.shape[1]

    def add(self, low: np.ndarray, ready: np.ndarray, lanes: np.ndarray | slice = slice(None)) -> None:
        """The upper bits of these lanes: written for each, and kept by those that are ready, which go on behind them."""
        width = self.rows.shape[1]
        if self.most == width:  # no lane holds more
            self.most = int((self.at - self.begins()).max())
            if 4 * self.most > 3 * width:
                self.at += self.begins()
                self.rows = np.pad(self.rows, ((0, 0), (0, width)))
        self.rows.ravel()[self.at[lanes]] = (low >> _TOP).astype(np.uint16)
        self.at[lanes] += ready
        self.most += 1

    def lanes(self, low: np.ndarray) -> list[bytes]:
        raw, tails = self.rows.astype(">u2").tobytes(), low.astype(">u8").tobytes()
        begins, ends = 2 * self.begins(), 2 * self.at
        return [raw[b:e] + tails[8 * i : 8 * i + 8] for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist()))]


def code(ids: np.ndarray, alphabet: int) -> list[bytes]:
    """The coded bytes of every lane."""
    n = len(ids)
    lanes, each = _layout(n)
    steps = np.zeros(lanes * each, np.uint32)
    steps[:n] = ids
    steps = np.ascontiguousarray(steps.reshape(lanes, each).T)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, ~U64(0))
    sent = Sent(lanes, each + 64)
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    model = Mixer(alphabet)
    last = n - (lanes - 1) * each
    for t in range(each):
        a = lanes if t < last else lanes - 1
        now = steps[t, :a]
        model.predict(one[:a], two[:a])
        start, width = model.interval(now)
        r = size[:a] >> model.bits
        start *= r
        low[:a] += start
        np.multiply(r, width, out=size[:a])
        ready = size < _BOTTOM  # about half of all lanes, so this step is done in all of them
        sent.add(low, ready)
        _shrunk(low, size, ready)
        lane = (size < _BOTTOM).nonzero()[0]
        while len(lane):
            l, s, ready = low[lane], size[lane], np.ones(len(lane), bool)
            sent.add(l, ready, lane)
            _shrunk(l, s, ready)
            low[lane], size[lane] = l, s
            lane = lane[s < _BOTTOM]
        model.update(now)
        two[:a], one[:a] = one[:a], now
    return sent.lanes(low)


def decode(parts: list[bytes], n: int, alphabet: int) -> np.ndarray:
    lanes = len(parts)  # as coded, whatever the layout is now
    each = -(-n // lanes)
    row = max(map(len, parts)) // 2 + 1  # a place more, which is looked at but not taken
    data = np.frombuffer(b"".join(p.ljust(2 * row, b"\0") for p in parts), ">u2").astype(np.uint16).reshape(lanes, row)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, ~U64(0))
    value = np.zeros(lanes, np.uint64)
    for i in range(4):
        value = value << _SHIFT | data[:, i]
    data, at = data.ravel(), np.arange(lanes) * row + 4
    one, two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    model = Mixer(alphabet)
    most = (U64(1) << model.bits) - U64(1)
    ids = np.zeros((each, lanes), np.uint32)
    last = n - (lanes - 1) * each
    for t in range(each):
        a = lanes if t < last else lanes - 1
        model.predict(one[:a], two[:a])
        r = size[:a] >> model.bits
        place = value[:a] - low[:a]
        place //= r
        now = model.find(np.minimum(place, most, out=place))
        start, width = model.interval(now)
        start *= r
        low[:a] += start
        np.multiply(r, width, out=size[:a])
        ready = size < _BOTTOM
        value <<= _shrunk(low, size, ready)
        value |= data[at] * ready
        at += ready
        lane = (size < _BOTTOM).nonzero()[0]
        while len(lane):
            l, s = low[lane], size[lane]
            value[lane] = value[lane] << _shrunk(l, s, np.ones(len(lane), bool)) | data[at[lane]]
            at[lane] += 1
            low[lane], size[lane] = l, s
            lane = lane[s < _BOTTOM]
        model.update(now)
        ids[t, :a] = now
        two[:a], one[:a] = one[:a], now
    return ids.T.ravel()[:n]


def write_block(doc_ids: list[int | None], lengths: list[int], ids: bytes, alphabet: int) -> bytes:
    values = np.frombuffer(ids, "<u4")
    lanes = code(values, alphabet)
    known = np.array([_NULL if d is None else d for d in doc_ids], "<i8")
    index = zlib.compress(known.tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    body = b"".join(
        [struct.pack("<I", len(index)), index, np.array([len(x) for x in lanes], "<u4").tobytes(), *lanes]
    )
    return _HEADER.pack(_MAGIC, len(values), len(doc_ids), len(lanes), alphabet, zlib.crc32(body), zlib.crc32(ids)) + body


def read_block(block: bytes) -> tuple[list[int | None], list[int], bytes]:
    """Document ids, lengths and ids; raises where a checksum does not hold."""
    magic, n, docs, lanes, alphabet, body_crc, ids_crc = _HEADER.unpack_from(block)
    body = block[_HEADER.size :]
    if magic != _MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    (size,) = struct.unpack_from("<I", body)
    index = zlib.decompress(body[4 : 4 + size])
    known = np.frombuffer(index, "<i8", docs).tolist()
    lengths = np.frombuffer(index, "<u4", docs, 8 * docs).tolist()
    ends = np.cumsum(np.r_[4 + size + 4 * lanes, np.frombuffer(body, "<u4", lanes, 4 + size)]).tolist()
    ids = decode([body[s:e] for s, e in zip(ends, ends[1:])], n, alphabet).astype("<u4").tobytes()
    if zlib.crc32(ids) != ids_crc:
        raise ValueError("damaged block")
    return [None if d == _NULL else d for d in known], lengths, ids


def _write(path: str, end_id: int, block_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_level(path)
        alphabet = len(vocabulary.last)
        tail = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        docs, parts, held, number, offset = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, parts, held, number, offset
            block = write_block(docs, [len(p) // 4 for p in parts], b"".join(parts), alphabet)
            row = (part, number, offset, held, block)
            docs, parts, number, offset, held = [], [], number + 1, offset + held, 0
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in row[:4]), pa.array([row[4]], pa.binary())],
                names=["file", "block", "ids_before", "n_ids", "data"],
            )

        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for some in slices(batch.column(1).to_pylist()):
                for doc, ids in zip(doc_ids[at : at + len(some)], vocabulary.encode(some)):
                    docs.append(doc)
                    parts.append(ids + tail)
                    held += len(ids) // 4 + 1
                    if held >= block_ids:
                        yield flush()
                at += len(some)
        if docs:
            yield flush()

    return run


def write_blocks(
    docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """The block files: file, block, ids_before (of this file), n_ids and data, in ascending order of doc_id."""
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    ordered = (
        texts_of(docs)
        .repartitionByRange(partitions(docs), F.col("doc_id").asc_nulls_last())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    )
    blocks = ordered.mapInArrow(
        releasing(_write(path, end_id, block_ids)), "file long, block long, ids_before long, n_ids long, data binary"
    )
    return keep(blocks, "token-blocks")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            docs, lengths, ids = read_block(data.as_py())
            ends = np.cumsum([0, *lengths]).tolist()
            for first in range(0, len(docs), BATCH_ROWS):
                some = ends[first : first + BATCH_ROWS + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[first : first + BATCH_ROWS], pa.int64()),
                        pa.array([before + s for s in some[:-1]], pa.int64()),
                        pa.array([ids[4 * s : 4 * e] for s, e in zip(some, some[1:])], pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )


def read_blocks(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before) and ids (binary, little-endian 32 bit) of every document."""
    sizes = sorted(files.groupBy("file").agg(F.sum("n_ids").alias("n")).collect())  # a row a file
    starts, total = [], 0
    for r in sizes:
        starts.append((r.file, total))
        total += r.n
    table = files.sparkSession.createDataFrame(starts, "file long, first long")
    return (
        files.join(F.broadcast(table), "file")
        .select((F.col("first") + F.col("ids_before")).alias("before"), "data")
        .mapInArrow(releasing(_read), "doc_id long, start long, ids binary")
    )


def op8_token_blocks(spark, sf_dir: str) -> DataFrame:
    files = write_blocks(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_blocks(files).select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
