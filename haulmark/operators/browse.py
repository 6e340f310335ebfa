"""Filtered, sorted, paged and exported shipment listings."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.times import time_literal
from haulmark.schemas import EXPORT_COLUMNS, IN_TRANSIT_COLUMNS, KPI_COLUMNS

When = dt.date | dt.datetime | str
MAX_PAGE = 200


def status_is(status: str) -> Column:
    if status.lower() not in ("late", "on_time"):
        raise ValueError("status must be 'late' or 'on_time'")
    return F.col("is_late") == F.lit(status.lower() == "late")


def state_is(state: str) -> Column:
    return F.col("seller_state") == F.lit(state.upper())


def id_contains(text: str) -> Column:
    """Case-insensitive match inside either id; ``%`` and ``_`` keep their LIKE meaning."""
    return F.col("order_id").ilike(f"%{text}%") | F.col("seller_id").ilike(f"%{text}%")


def filter_shipments(
    df: DataFrame,
    status: str | None = None,
    state: str | None = None,
    date_from: When | None = None,
    date_to: When | None = None,
    search: str | None = None,
    category: str | None = None,
    is_late: bool | None = None,
) -> DataFrame:
    """All given conditions together; both ends of the time range are included."""
    wanted: list[Column] = []
    if status is not None:
        wanted.append(status_is(status))
    if state is not None:
        wanted.append(state_is(state))
    if date_from is not None:
        wanted.append(F.col("purchase_timestamp") >= time_literal(df, "purchase_timestamp", date_from))
    if date_to is not None:
        wanted.append(F.col("purchase_timestamp") <= time_literal(df, "purchase_timestamp", date_to))
    if search is not None:
        wanted.append(id_contains(search))
    if category is not None:
        wanted.append(F.col("category_name") == category)
    if is_late is not None:
        wanted.append(F.col("is_late") == is_late)
    return df.where(reduce(lambda a, b: a & b, wanted)) if wanted else df


def within(df: DataFrame, start: When, end: When) -> DataFrame:
    """Purchases from ``start`` up to, but not at, ``end``."""
    bought = F.col("purchase_timestamp")
    return df.where(
        (bought >= time_literal(df, "purchase_timestamp", start))
        & (bought < time_literal(df, "purchase_timestamp", end))
    )


def details(df: DataFrame) -> DataFrame:
    """The listing columns; missing states show as empty text."""
    columns = [
        "order_id",
        "seller_id",
        F.coalesce("seller_state", F.lit("")).alias("seller_state"),
        F.coalesce("customer_state", F.lit("")).alias("customer_state"),
        "distance_km",
        "delay_days",
        "is_late",
        F.col("freight_value").cast("double").alias("freight_value"),
        "category_name",
        "purchase_timestamp",
        "delivered_timestamp",
    ]
    if "prediction_probability" in df.columns:
        columns.append("prediction_probability")
    return df.select(*columns)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_first("purchase_timestamp"), "order_id")


def check_page(page: int, size: int) -> None:
    if page < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and size between 1 and {MAX_PAGE}")


def page_of(df: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One page by offset: a distributed top-k of ``page * size`` rows."""
    check_page(page, size)
    return newest_first(df).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, purchased: When, order_id: str, size: int = 50) -> DataFrame:
    """The page behind a known row. Costs the same however deep the page is."""
    check_page(1, size)
    bought, mark = F.col("purchase_timestamp"), time_literal(df, "purchase_timestamp", purchased)
    behind = (bought < mark) | ((bought == mark) & (F.col("order_id") > order_id))
    return newest_first(df.where(behind)).limit(size)


def page_totals(df: DataFrame, size: int = 50) -> DataFrame:
    check_page(1, size)
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / F.lit(size)).cast("bigint")
    )


def of_seller(df: DataFrame, seller_id: str) -> DataFrame:
    return df.where(F.col("seller_id") == seller_id)


def one_order(df: DataFrame, order_id: str) -> DataFrame:
    """The matching row, at most two of them so that a duplicate is noticed."""
    return df.where(F.col("order_id") == order_id).limit(2)


def found(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise LookupError(f"{what} not found")
    return df


def kpi_rows(df: DataFrame) -> DataFrame:
    return df.select(*KPI_COLUMNS)


def all_order_rows(df: DataFrame) -> DataFrame:
    """KPI rows of orders of every status, with that status."""
    return df.select(*KPI_COLUMNS, "order_status")


def in_transit(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Shipments without a delivery time; ``limit`` keeps the most urgent promises."""
    rows = df.where(F.col("delivered_timestamp").isNull()).select(*IN_TRANSIT_COLUMNS)
    if limit is None:
        return rows
    return rows.orderBy(F.asc_nulls_last("estimated_delivery"), "order_id").limit(limit)


def export_rows(df: DataFrame) -> DataFrame:
    """Export layout, newest first, with empty text for missing text."""
    rows = df.withColumn("freight_value", F.col("freight_value").cast("double")).select(*EXPORT_COLUMNS)
    filled = rows.na.fill("", ["seller_state", "customer_state", "category_name"])
    return newest_first(filled)


def write_export(df: DataFrame, path: str) -> None:
    """Sorted CSV parts with a header each; part names follow the sort order."""
    export_rows(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
