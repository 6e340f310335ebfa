"""Orders and their satellites reduced to one row per order."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import numbers, times
from haulmark.operators.lookups import lookup_small, lookup_stored
from haulmark.schemas import CANONICAL_NAMES, ORDER_TIMESTAMPS

Sources = Mapping[str, DataFrame]

ITEM_VALUES = ["product_id", "seller_id", "price", "freight_value"]


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys]))


def keep_first(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per key: the first in ``order_by``.

    An aggregate rather than a window, so copies of a key are dropped before the shuffle and a
    key with very many copies never gathers in one task. The key stays the grouping column, so
    filters on it reach the scan and later joins on it need no further shuffle.
    """
    others = [c for c in df.columns if c != key]
    if not others:
        return df.distinct()
    first = F.min_by(F.struct(*others), F.struct(*order_by))
    rows = df.groupBy(key).agg(first.alias("_row"))
    return rows.select(*[F.col(c) if c == key else F.col(f"_row.{c}") for c in df.columns])


def parse_timestamps(df: DataFrame, columns: list[str] = ORDER_TIMESTAMPS) -> DataFrame:
    """Text columns to UTC timestamps; typed columns only change to a wall clock."""
    parsed: dict[str, Column] = {}
    for name in columns:
        if name in df.columns:
            is_text = df.schema[name].dataType.typeName() == "string"
            parsed[name] = times.utc_timestamp(F.col(name)) if is_text else F.col(name).cast("timestamp_ntz")
    return df.withColumns(parsed)


def unique_orders(orders: DataFrame, order_by: list[str]) -> DataFrame:
    """Keyed, deduplicated orders of every status with typed timestamps and canonical names."""
    kept = keep_first(drop_null_keys(orders, "order_id"), "order_id", order_by)
    return parse_timestamps(kept).withColumnsRenamed(CANONICAL_NAMES)


def delivered_only(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status") == "delivered")


_ITEM_RANK = f"struct(coalesce(order_item_id, {2**63 - 1}) as order_item_id, {', '.join(ITEM_VALUES)})"


def item_states(items: DataFrame) -> DataFrame:
    """Per order, minima that tell the first non-null value of each column; least() merges two of them.

    Rows without any null, the usual case, feed one running minimum; only rows with a null
    feed the minimum of each single column. Items without a number come last.
    """
    complete = " and ".join(f"{name} is not null" for name in ITEM_VALUES)
    first = F.expr(f"min(if({complete}, {_ITEM_RANK}, null)) as _complete")
    partial = [
        F.expr(f"min(if(not ({complete}) and {name} is not null, {_ITEM_RANK}, null)) as _{name}") for name in ITEM_VALUES
    ]
    return drop_null_keys(items, "order_id").groupBy("order_id").agg(first, *partial)


def item_value(name: str) -> Column:
    """The first value of a column of the items, from their states."""
    return F.expr(f"least(_complete, _{name}).{name} as {name}")


def first_items(items: DataFrame) -> DataFrame:
    """Per order and column, the first non-null value by item number."""
    return item_states(items).select("order_id", *[item_value(name) for name in ITEM_VALUES])


def payment_totals(payments: DataFrame) -> DataFrame:
    paid = F.sum(F.col("payment_value").cast("decimal(18,2)"))
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        drop_null_keys(payments, "order_id")
        .groupBy("order_id")
        .agg(F.coalesce(paid, zero).cast("decimal(18,2)").alias("payment_value"))
    )


def best_reviews(reviews: DataFrame) -> DataFrame:
    return (
        drop_null_keys(reviews, "order_id")
        .groupBy("order_id")
        .agg(F.max("review_score").cast("smallint").alias("review_score"))
    )


def english_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    named = lookup_small(products, translation, "product_category_name")
    return named.select("product_id", F.col("product_category_name_english").alias("category_name"))


def with_delay(df: DataFrame) -> DataFrame:
    delay = times.delay_days(F.col("delivered_timestamp"), F.col("estimated_delivery"))
    return df.withColumn("delay_days", delay).withColumn("is_late", times.late_flag(F.col("delay_days")))


def all_orders(sources: Sources, order_by: list[str]) -> DataFrame:
    """Every order, whatever its status, with its seller and delay."""
    orders = unique_orders(sources["orders"], order_by)
    sellers = first_items(sources["order_items"]).select("order_id", "seller_id")
    return with_delay(orders.join(sellers, "order_id", "left"))


def order_facts(sources: Sources, order_by: list[str], delivered: bool = True) -> DataFrame:
    """Orders joined to everything keyed by order: one co-partitioned stage."""
    orders = unique_orders(sources["orders"], order_by)
    if delivered:
        orders = delivered_only(orders)
    joined = (
        orders.join(first_items(sources["order_items"]), "order_id", "left")
        .join(payment_totals(sources["order_payments"]), "order_id", "left")
        .join(best_reviews(sources["order_reviews"]), "order_id", "left")
    )
    return with_delay(priced(joined))


def priced(df: DataFrame) -> DataFrame:
    return df.withColumns({name: numbers.money(F.col(name)) for name in ("price", "freight_value")})


def with_dimensions(
    facts: DataFrame,
    products: DataFrame | None = None,
    sellers: DataFrame | None = None,
    customers: DataFrame | None = None,
) -> DataFrame:
    """Attach product, seller and customer attributes; a query skips those it does not read."""
    for table, key in ((products, "product_id"), (sellers, "seller_id"), (customers, "customer_id")):
        if table is not None:
            facts = lookup_stored(facts, table, key)
    return facts


def clean_shipments(sources: Sources, order_by: list[str], delivered: bool = True) -> DataFrame:
    """The cleaned fact: one row per order with category, states, zips, money and delay."""
    return with_dimensions(
        order_facts(sources, order_by, delivered),
        english_categories(sources["products"], sources["category_translation"]),
        sources["sellers"].select("seller_id", "seller_zip_code_prefix", "seller_state"),
        sources["customers"].select("customer_id", "customer_zip_code_prefix", "customer_state"),
    )
