"""Left joins from many rows to a keyed lookup.

A broadcast is hinted only for the list of heavy keys, whose length arithmetic bounds, and for lookups whose size was
checked; otherwise Spark broadcasts
a side only when the size it knows (file statistics, or the measured shuffle output under adaptive execution) is below
``spark.sql.autoBroadcastJoinThreshold``. Beyond that size the joins below stay balanced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.staging import stage


def lookup_stored(rows: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left join to a lookup that is read straight from storage.

    Both sides shuffle right below the join, so adaptive execution can split a hot key.
    """
    return rows.join(lookup.where(F.col(on).isNotNull()), on, "left")


SMALL_ROWS, SMALL_CHARS = 10_000, 1_000_000


def lookup_small(rows: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left join to a lookup that is expected to be short, by a key of few values.

    Its size is checked, which reads at most ``SMALL_ROWS`` + 1 of its rows. Within the bounds it is broadcast and the
    rows stay where they are; a longer one is joined like any stored lookup.
    """
    known = lookup.where(F.col(on).isNotNull())
    chars = sum((F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in lookup.columns), F.lit(0))
    size = known.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars")).first()
    if size.n > SMALL_ROWS or (size.chars or 0) > SMALL_CHARS:
        return lookup_stored(rows, lookup, on)
    return rows.join(F.broadcast(known), on, "left")


def key_weights(rows: DataFrame, on: str) -> DataFrame:
    """Rows per key, from a pass over the key column alone."""
    return stage(rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("n")), "weights")


def heavy_keys(weights: DataFrame, on: str, tasks: int) -> DataFrame:
    """Keys that hold more than a fair share of the rows, 1 / ``tasks``, and in how many shares to split them.

    Fewer than ``tasks`` keys can hold more than such a share, and their shares are fewer than ``tasks`` plus their
    number, whatever the table's size.
    """
    share = weights.agg(F.sum("n") / F.lit(tasks)).scalar()
    heavy = weights.where(F.col(on).isNotNull() & (F.col("n") > share))
    return heavy.select(on, F.ceil(F.col("n") / share).cast("int").alias("_shares"))


def salted(lookup: DataFrame, heavy: DataFrame, on: str) -> DataFrame:
    """The lookup with a row for each share of a heavy key, and one for every other key."""
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    known = lookup.where(F.col(on).isNotNull()).join(F.broadcast(heavy), on, "left")
    return known.withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")


def lookup_derived(
    rows: DataFrame, lookup: DataFrame, on: str, spread_by: str, weights: DataFrame | None = None
) -> DataFrame:
    """Left join to a lookup that was itself aggregated by ``on``.

    Such a lookup is already partitioned by the key, which would pin every row of a hot key to
    one task. So the heavy keys, and only those, are split into shares by the hash of
    ``spread_by``, and their lookup row is repeated for each share. ``weights`` are the rows per
    key (``on``, ``n``), read twice, so they should be stored; by default a pass over ``rows`` counts them.
    """
    tasks = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = heavy_keys(key_weights(rows, on) if weights is None else weights, on, tasks)
    spread = F.when(F.col("_shares").isNotNull(), F.pmod(F.hash(spread_by), F.col("_shares"))).otherwise(0)
    split = rows.join(F.broadcast(heavy), on, "left").withColumn("_salt", spread).drop("_shares")
    return split.join(salted(lookup, heavy, on), [on, "_salt"], "left").drop("_salt")
