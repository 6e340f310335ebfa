"""Orders known so far, as states that parts of the inputs merge into.

A state holds, per order, what a part of the inputs says of it: the first row of the order and its place, minima of its
items, the sum of its payments and the best review. States of two parts merge column by column, so a new part is
enough to bring an order up to date.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators import cleaning as c
from haulmark.schemas import ORDER_STATES
from haulmark.sources import csv_files
from haulmark.sources.stored import conform

ORDER_KEYED = ["orders", "order_items", "order_payments", "order_reviews"]
ITEMS = [name for name, _, _ in ORDER_STATES if name.startswith("_")]
ORDER = ["customer_id", "order_status", *[name for name, kind, _ in ORDER_STATES if kind == "timestamp_ntz"]]


def unread(table: str, files: Mapping[str, int], known: Mapping[str, list]) -> list[str]:
    """Files that the manifest does not know; refuses a folder in which a known one went or changed."""
    for file, (size, _) in known.items():
        if files.get(file) != size:
            raise ValueError(f"{table}: {file} was read before and has changed; load the tables anew")
    return sorted(set(files) - set(known))


def check_digests(spark: SparkSession, known: Mapping[str, Mapping[str, list]]) -> None:
    read = {file: digest for files in known.values() for file, (_, digest) in files.items()}
    for file, digest in csv_files.digests(spark, sorted(read)).items():
        if read[file] != digest:
            raise ValueError(f"{file} was read before and has other content now; load the tables anew")


def states_of(parts: Mapping[str, DataFrame], ordinal: list[str], load: int) -> DataFrame:
    """One state per order of these parts."""
    made = []
    if "orders" in parts:
        rows = c.unique_orders(parts["orders"], ordinal)
        made.append(rows.withColumn("place", F.struct(F.lit(load).alias("load"), *ordinal)).drop(*ordinal))
    if "order_items" in parts:
        made.append(c.item_states(parts["order_items"]))
    if "order_payments" in parts:
        made.append(c.payment_totals(parts["order_payments"]))
    if "order_reviews" in parts:
        made.append(c.best_reviews(parts["order_reviews"]))
    return conform(reduce(lambda a, b: a.join(b, "order_id", "full"), made), ORDER_STATES)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The orders of ``new`` with what ``old`` knows of them."""
    known = old.select("order_id", F.struct(*[name for name, _, _ in ORDER_STATES[1:]]).alias("_old"))
    both = new.join(known, "order_id", "left")
    # An order's first row stays; a state without one may get it later.
    first = F.col("_old.place").isNotNull() & (F.col("place").isNull() | (F.col("_old.place") <= F.col("place")))
    taken = {name: F.when(first, F.col(f"_old.{name}")).otherwise(F.col(name)) for name in ("place", *ORDER)}
    taken |= {name: F.least(f"_old.{name}", name) for name in ITEMS}
    paid, before = F.col("payment_value"), F.col("_old.payment_value")
    taken["payment_value"] = F.coalesce((paid + before).cast("decimal(18,2)"), paid, before)
    taken["review_score"] = F.greatest("_old.review_score", "review_score")
    return both.select("order_id", *[taken[name].alias(name) for name, _, _ in ORDER_STATES[1:]])


def facts_of(states: DataFrame) -> DataFrame:
    """Order facts of all statuses; what belongs to no order yet waits in its state."""
    rows = states.where(F.col("place").isNotNull())
    values = [c.item_value(name) for name in c.ITEM_VALUES]
    facts = rows.select("order_id", *ORDER, *values, "payment_value", "review_score")
    return c.with_delay(c.priced(facts))
