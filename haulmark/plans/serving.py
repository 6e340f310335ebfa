"""Requests answered from the stored tables: figures from their ledgers, listings from the months that matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.functions.times import Day
from haulmark.operators import browse, kpi, pages, rollup
from haulmark.plans import jobs


def kpi_summary(spark: SparkSession, root: str) -> DataFrame:
    return rollup.kpi_summary(jobs.shipments_table(spark, root).sums, jobs.all_orders_table(spark, root).sums("status"))


def seller_scorecard(
    spark: SparkSession, root: str, sort_by: str = "delay_rate", order: str = "desc", limit: int = 50
) -> DataFrame:
    card = rollup.seller_scorecard(jobs.shipments_table(spark, root).sums)
    return kpi.first_sellers(card, sort_by, order, limit)


def weekly_otif_trend(spark: SparkSession, root: str, weeks: int = 8) -> DataFrame:
    return rollup.weekly_otif_trend(jobs.shipments_table(spark, root).sums, weeks)


def delay_by_category(spark: SparkSession, root: str) -> DataFrame:
    return rollup.delay_by_category(jobs.shipments_table(spark, root).sums)


def shipments_page(spark: SparkSession, root: str, page: int = 1, size: int = 50) -> DataFrame:
    """A page of all shipments; its place is known from the ledger's days, so only its months are opened."""
    table = jobs.shipments_table(spark, root)
    days = table.sums("day").select("date", "n")
    return browse.details(pages.ranked_page(table.read(), page, size, days, table.between))


def shipments_between(spark: SparkSession, root: str, first: Day, end: Day, **conditions) -> DataFrame:
    """The listing of a time range up to, but without, ``end``; opens only its months."""
    rows = jobs.shipments_table(spark, root).between(str(first), str(end))
    return browse.details(browse.filter_shipments(rows, **conditions))


def shipments_search(spark: SparkSession, root: str, text: str, **conditions) -> DataFrame:
    """Shipments whose order or seller id contains ``text``; opens only files that may hold one."""
    rows = jobs.shipments_table(spark, root).search(text)
    return browse.details(browse.filter_shipments(rows, **conditions))
