"""Line dedup that returns compressed keep bitmaps.

A line's key is the line without white space at both ends and with A-Z in lower case. Of keys of at least
``MIN_CHARS`` code points that two documents hold, all lines go but those of the smallest document.

128-bit hashes of the keys are range-partitioned with document and position behind them, and each partition is streamed
in that order: the first document of a hash keeps its lines. A hash that many documents hold is cut at document
boundaries into several partitions; the smallest document of a partition's first hash is then looked up among the
partitions' bounds, of which there is one row a partition.

Nulls: a null or empty text is one empty line. A null ``doc_id`` counts as larger than all others. Rows with the same
id are one document to this rule. Repeated rows give repeated results; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.common import WHITE, keep, partitions, texts_of

MIN_CHARS = 10
_LAST = (1 << 63) - 1
_WHITE = WHITE.decode()
ORDER = ("one", "two", "doc", "print", "line")


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce("doc_id", F.lit(_LAST)).alias("doc")
    return texts_of(docs).select("doc_id", doc, F.xxhash64("text").alias("print"), "text")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, prints, lines, digests = [], [], [], []
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            for i, line in enumerate(text.split("\n")):
                key = line.strip(_WHITE)
                if len(key) >= MIN_CHARS:
                    docs.append(doc)
                    prints.append(mark)
                    lines.append(i)
                    digests.append(hashlib.sha256(key.encode("utf-8", "surrogatepass").lower()).digest()[:16])
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [both[:, 0], both[:, 1], np.array(docs, np.int64), np.array(prints, np.int64), np.array(lines, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=list(ORDER))


def _later(holders: dict[int, tuple[int, int, int]]) -> Callable:
    """Lines of documents other than the first of their hash. Rows come by partition of the sort, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, holder = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            parts, one, two, doc, mark, line = (c.to_numpy() for c in batch.columns)
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (parts[1:] != parts[:-1])]
            heads = np.flatnonzero(new)
            first = doc[heads].copy()
            for i in np.flatnonzero(np.r_[True, np.diff(parts[heads]) != 0]):
                at = heads[i]
                here = (one[at], two[at])
                if parts[at] == part and here == key:
                    first[i] = holder  # goes on from the batch before
                elif parts[at] != part and int(parts[at]) in holders and holders[int(parts[at])][:2] == here:
                    first[i] = holders[int(parts[at])][2]
            part, key, holder = parts[-1], (one[-1], two[-1]), first[-1]
            drop = doc != first[np.cumsum(new) - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[drop]), pa.array(mark[drop]), pa.array(line[drop])], names=["doc", "print", "line"]
            )

    return run


def _holders(bounds: list) -> dict[int, tuple[int, int, int]]:
    """For partitions whose first hash began before: that hash and its smallest document."""
    out, last, holder = {}, None, 0
    for r in sorted(bounds, key=lambda r: r.part):
        first = (r.low.one, r.low.two)
        holder = holder if first == last else r.low.doc
        if first == last:
            out[r.part] = (*first, holder)
        top = (r.high.one, r.high.two)
        if top != first:
            holder = r.high.doc
        last = top
    return out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            kept = np.ones(n, bool)
            kept[lines or []] = False
            maps.append(zlib.compress(np.packbits(kept).tobytes(), 1))
            dropped.append(n - int(kept.sum()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            names=["doc", "print", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc, print (which name a text), n_lines, n_dropped and keep: the zlib-compressed bits of the lines that stay."""
    keyed = _keyed(docs)
    lines = keep(
        keyed.select("doc", "print", "text").mapInArrow(_lines, ", ".join(f"{c} long" for c in ORDER)), "lines"
    )
    n = partitions(docs)
    ranged = lines.repartitionByRange(n, "one", "two", "doc").select(F.spark_partition_id().cast("long").alias("part"), *ORDER)
    ranged = keep(ranged, "lines-ranged")
    low = F.struct("one", "two", "doc")
    # The last hash of a partition, with its smallest document there.
    last = ranged.groupBy("part").agg(F.min(low).alias("low"), F.max(F.struct("one", "two")).alias("top"))
    tops = (
        ranged.join(F.broadcast(last.select("part", "top")), "part")
        .where(F.struct("one", "two") == F.col("top"))
        .groupBy("part")
        .agg(F.min(low).alias("high"))
    )
    holders = _holders(last.join(tops, "part").select("part", "low", "high").collect())  # a row a partition
    drops = (
        ranged.repartition(n, "part")
        .sortWithinPartitions("part", *ORDER)
        .mapInArrow(_later(holders), "doc long, print long, line long")
        .groupBy("doc", "print")
        .agg(F.collect_set("line").alias("lines"))
    )
    sizes = keyed.select("doc", "print", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    return (
        sizes.dropDuplicates(["doc", "print"])
        .join(drops, ["doc", "print"], "left")
        .mapInArrow(_bitmaps, "doc long, print long, n_lines long, n_dropped long, keep binary")
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, n, bits in zip(*(c.to_pylist() for c in batch.columns[:3])):
            stay = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n)
            kept.append("\n".join([x for x, k in zip(text.split("\n"), stay.tolist()) if k]))
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(kept, pa.string())], names=[*batch.schema.names[3:], "kept"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    joined = _keyed(docs).join(keep_bitmaps(docs), ["doc", "print"])
    return joined.select("text", "n_lines", "keep", "doc_id", F.col("n_lines").alias("lines"), "n_dropped").mapInArrow(
        _apply, "doc_id long, lines long, n_dropped long, kept string"
    ).withColumnRenamed("lines", "n_lines")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
