"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when they are identical after deleting the white space of ``common.WHITE``. Each task first merges
the copies it meets in a batch by comparing bytes, so a text that a third of all rows share travels once a batch. The
survivors are entered in an extendible-hash index: a directory over the leading key bits that doubles while a bucket
is overfull, and buckets owned by tasks. An owner reads its key range in key order, chains the texts of one key and
compares their bytes, so equal hashes of different texts never merge. Entries are written to the shared folder.

Nulls: a null text is empty, and all empty or white texts are one group. A null ``doc_id`` sorts behind all others.
Repeated rows are copies, of which exactly one row stays. Ties in length go to the smallest ``doc_id``. An empty
table gives an empty result. Other columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import WHITE, keep, partitions, releasing, texts_of

MAX_DEPTH = 18  # directory of 2**18 entries at most
BUCKET_ROWS = 512
_LAST = (1 << 63) - 1

ENTRY = (
    "row_id long, rep_id long, doc_id long, n_chars long, text_sha256 string, key long, copies long,"
    " best_chars long, best_doc long, text string"
)


def _order(n_chars: int, doc_id: int | None, row_id: int) -> tuple:
    return (-n_chars, doc_id is None, doc_id or 0, row_id)


def _merge_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its local representative: the best row of a batch with the same text, which carries the text."""
    base = TaskContext.get().partitionId() << 36
    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [base + i for i in range(len(texts))]
        base += len(texts)
        best: dict[bytes, int] = {}
        count: dict[bytes, int] = {}
        bare = []
        for i, text in enumerate(texts):
            b = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
            bare.append(b)
            count[b] = count.get(b, 0) + 1
            j = best.get(b)
            if j is None or _order(len(text), doc_ids[i], i) < _order(len(texts[j]), doc_ids[j], j):
                best[b] = i
        digests = {b: hashlib.sha256(b).digest() for b in best}
        chosen = [best[b] for b in bare]
        own = [j == i for i, j in enumerate(chosen)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int64()),
                pa.array([rows[j] for j in chosen], pa.int64()),
                pa.array(doc_ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([digests[b].hex() for b in bare]),
                pa.array([int.from_bytes(digests[b][:8], "big", signed=True) for b in bare], pa.int64()),
                pa.array([count[b] if o else None for b, o in zip(bare, own)], pa.int64()),
                pa.array([len(texts[j]) for j in chosen], pa.int64()),
                pa.array([doc_ids[j] for j in chosen], pa.int64()),
                pa.array([t if o else None for t, o in zip(texts, own)], pa.string()),
                *batch.columns[2:],
            ],
            names=[c.split()[0] for c in ENTRY.split(",")] + batch.schema.names[2:],
        )


def directory(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(prefix at global depth, bucket, local depth) after splitting each overfull bucket, doubling where needed.

    ``counts`` has the entries below each prefix of ``depth`` bits. Buckets are numbered in key order.
    """
    sums = [dict(counts)]
    for _ in range(depth):  # sums[i]: entries below each prefix of depth - i bits
        up: dict[int, int] = {}
        for p, n in sums[-1].items():
            up[p >> 1] = up.get(p >> 1, 0) + n
        sums.append(up)
    buckets, open_ = [], [(0, 0)]
    while open_:
        prefix, local = open_.pop()
        if local < depth and sums[depth - local].get(prefix, 0) > capacity:
            open_ += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]
        else:
            buckets.append((prefix, local))
    glob = max(local for _, local in buckets)
    return [
        (p, number, local)
        for number, (prefix, local) in enumerate(buckets)
        for p in range(prefix << (glob - local), (prefix + 1) << (glob - local))
    ]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the texts of each key, compare bytes, and give every representative the row that stays.

    Input is sorted by bucket and key. Held: the distinct texts of one key, and row numbers.
    """
    names = ["rep_id", "bucket", "chain", "keep_id", "keep_row", "group_size"]

    def flush(chain: list, out: list) -> None:
        for place, (_, bucket, reps, size, top) in enumerate(chain):
            out += [(r, bucket, place, top[2] if not top[1] else None, top[3], size) for r in reps]

    def table(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * len(names))], names=names
        )

    current, chain, out = None, [], []
    for batch in batches:
        for bucket, key, row, doc, n, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, key) != current:
                flush(chain, out)
                current, chain = (bucket, key), []
            b = text.encode("utf-8", "surrogatepass").translate(None, WHITE)
            top = _order(n, doc, row)
            for link in chain:
                if link[0] == b:
                    link[2].append(row)
                    link[3] += copies
                    link[4] = min(link[4], top)
                    break
            else:
                chain.append([b, bucket, [row], copies, top])
        if len(out) > 10_000:
            yield table(out)
            out = []
    flush(chain, out)
    yield table(out)


def build_index(docs: DataFrame, *carry: str, capacity: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows with their local representative, and the index entries of the representatives, both in shared files.

    Rows carry their text and the columns in ``carry`` (text only where the row represents its batch's copies).
    Entries: rep_id, bucket, chain (place among texts of one key), keep_id, keep_row, group_size.
    """
    given = texts_of(docs, *[F.col(c).alias(f"_{c}") for c in carry])
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[2:])
    rows = keep(given.mapInArrow(releasing(_merge_locally), ENTRY + extra), "dedup-rows")
    reps = rows.where("copies is not null")
    top = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    counts = {r[0]: r[1] for r in reps.groupBy(top.alias("p")).count().collect()}  # 2**MAX_DEPTH rows at most
    slots = directory(counts, MAX_DEPTH, capacity)
    bits = len(slots).bit_length() - 1
    spark = docs.sparkSession
    table = spark.createDataFrame([(p, b) for p, b, _ in slots], "prefix long, bucket long")
    prefix = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    routed = reps.withColumn("prefix", prefix).join(F.broadcast(table), "prefix")
    entries = (
        routed.select("bucket", "key", "row_id", "doc_id", "n_chars", "copies", "text")
        .repartition(partitions(docs), "bucket")
        .sortWithinPartitions("bucket", "key")
        .mapInArrow(releasing(_own), "rep_id long, bucket long, chain long, keep_id long, keep_row long, group_size long")
    )
    return rows, keep(entries, "dedup-index")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    rows, entries = build_index(docs)
    found = entries.select("rep_id", "keep_id", "keep_row", "group_size")
    return (
        rows.select("row_id", "rep_id", "doc_id", "text_sha256")
        .join(found, "rep_id")
        .select(
            "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"
        )
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns; a null text comes back empty."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = {c: f"c{i}" for i, c in enumerate(others)}  # whatever signs the given names hold
    rows, entries = build_index(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(p) for c, p in plain.items()]), *plain.values())
    kept = entries.select(F.col("keep_row").alias("row_id")).distinct()
    values = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"_{p}") for c, p in plain.items()}
    return (
        rows.where("copies is not null").join(kept, "row_id", "left_semi").select(*[values[c].alias(c) for c in docs.columns])
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Deletes the six white characters; of equal texts the longest original, then the smallest id, stays.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g
"""
