"""Many small values of documents packed into one row per bucket, so that a shuffle moves bytes instead of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def runs_of_equal(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of equal values in a sorted array, and those values."""
    if not len(order_by):
        return np.zeros(1, np.int64), order_by
    cut = np.flatnonzero(np.r_[True, order_by[1:] != order_by[:-1]])
    return np.r_[cut, len(order_by)], order_by[cut]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first ... first + n - 1 of each entry, one behind the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def cut_up(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the values between each two bounds."""
    values = np.ascontiguousarray(values)
    at = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])


def _ascends(x: np.ndarray) -> bool:
    return not (x[1:] < x[:-1]).any()


def pack_by_bucket(
    bucket: np.ndarray, owner: np.ndarray, ids: np.ndarray, prints: np.ndarray, values: dict, lists: dict | None = None
) -> dict:
    """One row per bucket: the documents, how many entries each has, and the packed values of the entries.

    ``lists`` has (values, first of each entry, how many of each entry) where an entry has several.
    """
    n = len(bucket)
    if n and _ascends(owner) and bucket.min() >= 0 and bucket.max() < 1 << 16:
        # Sixteen bits are sorted by radix, which keeps the owners' order.
        order = None if _ascends(bucket) else np.argsort(bucket.astype(np.uint16), kind="stable")
    else:
        order = np.lexsort((owner, bucket))
    dealt = (lambda x: x) if order is None else (lambda x: x[order])
    bucket, owner = dealt(bucket), dealt(owner)
    new = np.r_[True, bucket[1:] != bucket[:-1]][:n]
    first = np.flatnonzero(new)
    head = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]][:n])  # of the entries of a document in a bucket
    bounds, heads = np.r_[first, n], np.r_[np.searchsorted(head, first), len(head)]
    who = owner[head]
    out = {
        "bucket": pa.array(bucket[first].astype(np.int64)),
        "docs": cut_up(ids[who], heads),
        "prints": cut_up(prints[who], heads),
        "counts": cut_up(np.diff(np.r_[head, n]).astype("<u4"), heads),
    }
    for k, v in values.items():
        out[k] = cut_up(dealt(v), bounds)
    for k, (v, start, many) in (lists or {}).items():
        start, many = dealt(start), dealt(many)
        out[k] = cut_up(v[ranges(start, many)], np.r_[0, np.cumsum(many)][bounds])
    return out


class Packer:
    """Entries of several runs of texts, packed together, since every row of a bucket costs as much as many entries."""

    def __init__(self, schema: pa.Schema, limit: int = 400_000):
        self.schema, self.limit = schema, limit
        self.clear()

    def clear(self) -> None:
        self.entries, self.docs, self.held = 0, 0, []

    def add(self, bucket: np.ndarray, owner: np.ndarray, ids: np.ndarray, prints: np.ndarray, values: dict) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket.astype(np.int32), owner + self.docs, ids, prints, values))
            self.entries, self.docs = self.entries + len(bucket), self.docs + len(ids)
        if self.entries >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            *columns, values = zip(*self.held)
            whole = {k: np.concatenate([v[k] for v in values]) for k in values[0]}
            columns = [np.concatenate(c) for c in columns]
            self.clear()
            yield as_batch(pack_by_bucket(*columns, whole), self.schema)


def unpack(frame: pd.DataFrame, kinds: dict[str, str]) -> tuple:
    """Document id, print and the values of every entry of a bucket."""
    join = lambda c, kind: np.frombuffer(b"".join(frame[c]), kind)
    counts = join("counts", "<u4").astype(np.int64)
    docs = np.repeat(join("docs", "<i8"), counts)
    prints = np.repeat(join("prints", "<i8"), counts)
    return docs, prints, *[join(c, kind) for c, kind in kinds.items()]


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)


def as_frame(columns: dict) -> pd.DataFrame:
    return pd.DataFrame({k: v.to_pandas() if isinstance(v, pa.Array) else v for k, v in columns.items()})


def packed_schema(*binary: str) -> pa.Schema:
    return pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in ("docs", "prints", "counts", *binary)])


def packed_ddl(*binary: str) -> str:
    return ", ".join(["bucket long"] + [f"{c} binary" for c in ("docs", "prints", "counts", *binary)])
