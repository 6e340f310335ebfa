"""The order-keyed sources bucketed by order, so that everything joined by order needs no shuffle.

Orders, items, payments and reviews are shuffled once, when they are staged; each bucket is one sorted file and bucket i
of every table holds the same orders. Aggregates by order and joins between them then run bucket by bucket. That
pays when the same inputs are read more than once: by several queries, or for several derived tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from haulmark.operators.cleaning import Sources, drop_null_keys
from haulmark.operators.lookups import heavy_keys, key_weights
from haulmark.staging import staging_root

ORDER_KEYED = ["orders", "order_items", "order_payments", "order_reviews"]
HEAVY_ROWS = 1_000_000  # an order with fewer rows than this fits any task


def has_heavy_order(table: DataFrame, buckets: int) -> bool:
    weights = key_weights(table, "order_id")
    return not heavy_keys(weights, "order_id", buckets).join(weights.where(f"n > {HEAVY_ROWS}"), "order_id").isEmpty()


def write_bucketed(table: DataFrame, path: str, buckets: int) -> None:
    """One file per bucket. The shuffle and the bucketing use the same hash, so each task writes whole buckets."""
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = table.repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").sortBy("order_id")
    writer.option("path", path).saveAsTable(name)
    table.sparkSession.sql(f"DROP TABLE {name}")  # external: the files stay, readers name them anew


def read_bucketed(spark: SparkSession, path: str, ddl: str, buckets: int) -> DataFrame:
    """The files of ``write_bucketed``, also those of another session."""
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (order_id) SORTED BY (order_id) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


class BucketedSources(Mapping):
    """The nine sources; the order-keyed ones are staged in buckets when first asked for, the others pass through.

    Rows without an order id belong to no order and are not staged. An input in which one order holds more than
    ``HEAVY_ROWS`` rows and more than a bucket's share is left as it is: its aggregates shrink it before the shuffle,
    while a bucket cannot be split.
    """

    def __init__(self, spark: SparkSession, sources: Sources, buckets: int | None = None, root: str | None = None):
        self._spark, self._sources = spark, sources
        self._buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._root = root or f"{staging_root(spark)}/haulmark/{spark.sparkContext.applicationId}/bucketed-{uuid.uuid4().hex}"
        self._built: dict[str, DataFrame] = {}

    def _stage(self, name: str) -> DataFrame:
        table = drop_null_keys(self._sources[name], "order_id")
        if has_heavy_order(table, self._buckets):
            return self._sources[name]
        path = f"{self._root}/{name}"
        write_bucketed(table, path, self._buckets)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
        return read_bucketed(self._spark, path, ddl, self._buckets)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in ORDER_KEYED:
            return self._sources[name]
        if name not in self._built:
            self._built[name] = self._stage(name)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._sources)

    def __len__(self) -> int:
        return len(self._sources)
