"""Helpers shared by the text operators: Arrow text buffers, 64-bit hashing, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.staging import staging_root

WHITE = b"\t\n\x0b\x0c\r "  # fixed: U+0009 to U+000D and the space
U64 = np.uint64
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, so that later uses neither repeat nor lose the work."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/haulmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that no plan needs any more deleted; Spark does so when the driver collects its garbage,
    which by itself it may do much later.
    """
    gc.collect()  # of Python's references to the driver's objects
    spark.sparkContext._jvm.System.gc()


def keep_by_key(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """``keep`` with Spark's bucketing: joins and groups by the keys read it without a shuffle.

    ``df`` should be partitioned by the keys into as many partitions as there are buckets, which gives one file each.
    """
    spark = df.sparkSession
    table = f"kept_{uuid.uuid4().hex}"
    path = f"{staging_root(spark)}/haulmark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(table)
    kept = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # external: the files stay
    return kept


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(df: DataFrame) -> None:
    """Hand whole texts to Python in small batches, unless the session has smaller ones.

    The settings count when a plan runs, so they stay set in the session.
    """
    conf = df.sparkSession.conf
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        have = int(str(conf.get(name)).lower().rstrip("b"))
        if not 0 < have <= bound:
            conf.set(name, bound)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty, plus the named columns, and nothing else."""
    small_batches(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one behind the other, and where each begins (one entry more than texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + U64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    # In place, as new arrays cost as much as the arithmetic.
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTES = mix(np.arange(256, dtype=np.uint64), 77)
_powers: dict[int, np.ndarray] = {}
POWERS = 1 << 21  # powers of a base that a worker keeps


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64. More than ``POWERS`` are computed anew each time."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = n if n > POWERS else min(POWERS, max(n, 1 << 16) * 5 // 4)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= POWERS:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Give memory that a task has freed back, since its Python worker lives on for the next stage."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(work: Callable) -> Callable:
    """``work`` on batches for ``mapInArrow``. Its worker waits small, beside those of other tasks and stages."""

    @wraps(work)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def releasing_group(work: Callable) -> Callable:
    """``work`` on the frame of a group for ``applyInPandas``, as ``releasing``."""

    @wraps(work)
    def run(frame):
        out = work(frame)
        release()
        return out

    return run


def runs_of(column: pa.Array, size: int = 1_000_000) -> Iterable[tuple[int, int]]:
    """(first, end) of runs of texts of about ``size`` bytes."""
    _, offsets = utf8(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end
        first = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes; ``span_hash`` turns them into hashes of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = _BYTES[data]
    terms *= powers(len(data))
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    return (prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start]


def gram_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """``span_hash`` of the n bytes from each place that has as many."""
    out = prefix[n:] - prefix[: len(prefix) - n]
    out *= inverse_powers(len(prefix))[: len(out)]
    return out


def inverse_powers(n: int) -> np.ndarray:
    """What takes the place of a span out of its hash; hold on to it where many spans of long bytes are hashed."""
    return powers(n, _INVERSE)


def below(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Spread hashes evenly over 0 ... n-1."""
    return (((x >> U64(32)) * np.asarray(n, np.uint64)) >> U64(32)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class ChunkTable(dict):
    """Distinct chunks and their solution, emptied whenever it outgrows its limit of entries or of characters."""

    def __init__(self, solve: Callable[[list[str]], Iterable], limit: int = 250_000, characters: int = 8_000_000):
        super().__init__()
        self.solve, self.limit, self.characters, self.held = solve, limit, characters, 0

    def fill(self, chunks: set[str]) -> None:
        if len(self) > self.limit or self.held > self.characters:
            self.clear()
            self.held = 0
        new = [c for c in chunks if c not in self]
        if new:
            self.held += sum(map(len, new))
            self.update(zip(new, self.solve(new), strict=True))


def slices(texts: list[str], size: int = 500_000) -> Iterable[list[str]]:
    """Runs of texts of about ``size`` characters, to bound what is held at a time."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t) + 16
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run
