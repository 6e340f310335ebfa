"""Three-letter postings of ids: which files hold an id with these letters.

A text of n letters has n - 2 runs of three. Every id that contains it has all of them, so the ids that stand in the
postings of each run are candidates; the files they are in are opened and the rows verified.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS, BUCKETS = 3, 64
DDL = "gram string, id bigint, file string"


def grams_of(text: str) -> set[str]:
    """Runs of three letters that every match of a LIKE pattern holds; none where postings cannot help."""
    if not text.isascii() or "\\" in text:
        return set()
    runs = re.split("[%_]", text.lower())
    return {run[i : i + LETTERS] for run in runs for i in range(len(run) - LETTERS + 1)}


def bucket_of(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def below_data(path: str) -> str:
    """The part of a path below the table's data folder, the same with and without a scheme."""
    return path.rpartition("/data/")[2]


def _grams(value: Column) -> Column:
    low = F.lower(value)
    starts = F.when(F.char_length(low) >= LETTERS, F.sequence(F.lit(1), F.char_length(low) - (LETTERS - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(low, i, F.lit(LETTERS))))


def of_files(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Postings of the id columns of a file scan; an id that repeats in a file is looked at once."""
    named = rows.select(*columns, F.col("_metadata.file_path").alias("file"))
    each = [
        named.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value"), "file").agg(F.lit(c).alias("kind")) for c in columns
    ]
    ids = reduce(DataFrame.unionByName, each)
    exploded = ids.select(F.explode(_grams(F.col("value"))).alias("gram"), F.xxhash64("kind", "value").alias("id"), "file")
    return exploded.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))


def candidates(postings: DataFrame, grams: set[str]) -> DataFrame:
    """Files with an id that has all of ``grams``."""
    hits = postings.where(F.col("gram").isin(*grams)).distinct()
    whole = hits.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return whole.select("file").distinct()
