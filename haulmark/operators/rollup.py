"""Indicators answered from a ledger's sums: each from the coarsest grain that has the dims it needs, none from rows.

``sums`` gives the sums of a grain: a stored table's ``sums``, or ``of_rows`` for shipments that are not stored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions import labels, numbers, times
from haulmark.operators import kpi, reporting
from haulmark.operators.ledger import SHIPMENT_LEDGER, Ledger, days, mean_delay, per_seller
from haulmark.staging import stage

Sums = Callable[[str], DataFrame]


def of_rows(rows: DataFrame, ledger: Ledger = SHIPMENT_LEDGER) -> Sums:
    """Sums of all grains from one pass over ``rows``, written once."""
    stored = stage(ledger.signed(rows), "rollup")
    return lambda grain: ledger.total(stored.where(F.col("grain") == grain), grain)


def route(sums: Sums, *dims: str, ledger: Ledger = SHIPMENT_LEDGER) -> DataFrame:
    """Sums by ``dims`` from the coarsest grain that has them."""
    found = sums(ledger.coarsest(*dims))
    if "week_start" in dims and "week_start" not in found.columns:
        found = found.withColumn("week_start", times.week_start(F.col("date")))
    kept = [F.sum(name).cast(kind).alias(name) for name, (kind, _) in ledger.measures.items()]
    return found.groupBy(*dims).agg(*kept)


def _on_time() -> Column:
    return numbers.per(F.col("n") - F.col("late"), F.col("n"))


def kpi_summary(sums: Sums, statuses: DataFrame) -> DataFrame:
    """The headline figures; ``statuses`` are the orders' sums by status."""
    weekly = route(sums, "week_start").select(
        F.col("week_start").alias("week"), "n", "late", days(F.col("late_delay_us")).alias("delay"),
        F.col("late_delay_n").alias("delay_n"), "freight", "freight_n",
    )
    done = F.sum(F.when(F.col("order_status") == "delivered", F.col("n")).otherwise(0))
    return kpi.summary_of(weekly, statuses.agg(F.sum("n").alias("all_n"), done.alias("delivered")))


def seller_scorecard(sums: Sums) -> DataFrame:
    return kpi.scorecard_of(
        per_seller(sums("seller")).select(
            "seller_id", "seller_state", F.col("n").alias("orders"), "late", days(F.col("late_delay_us")).alias("late_delay"),
            "late_delay_n", "freight", "freight_n",
        )
    )


def weekly_otif_trend(sums: Sums, weeks: int = 8) -> DataFrame:
    weekly = route(sums, "week_start").where(F.col("week_start").isNotNull())
    return kpi.filled_trend(weekly.select("week_start", (_on_time() * 100).alias("otif_rate")), weeks).orderBy("week_start")


def delay_by_category(sums: Sums) -> DataFrame:
    named = route(sums, "category_name").where(F.col("category_name").isNotNull())
    rows = named.select("category_name", mean_delay("late_").alias("avg_delay_days"), F.col("n").alias("order_count"))
    return rows.orderBy(F.desc_nulls_last("avg_delay_days"), "category_name")


def week_metrics(sums: Sums, week: times.Day) -> DataFrame:
    """The report's headline figures of a week, from the sums of two weeks of days."""
    monday = times.monday_of(week)
    now = F.col("date") >= F.lit(monday)
    fortnight = route(sums, "date").where((F.col("date") >= F.lit(monday - reporting.WEEK)) & (F.col("date") < F.lit(monday + reporting.WEEK)))

    def total(name: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(name))), F.lit(0))

    figures = fortnight.agg(
        total("n", now).alias("total"), total("late", now).alias("late"),
        numbers.per(days(total("delay_us", now)), total("delay_n", now)).alias("delay"),
        numbers.per(total("cost", now), total("cost_n", now)).alias("cost"),
        total("n", ~now).alias("prior"), total("late", ~now).alias("prior_late"),
    )
    return reporting.metrics_of(figures)


def week_otif_trend(sums: Sums, week: times.Day, weeks: int = 8) -> DataFrame:
    monday = times.monday_of(week)
    since = monday - dt.timedelta(days=7 * (weeks - 1))
    rows = route(sums, "week_start").where((F.col("week_start") >= F.lit(since)) & (F.col("week_start") <= F.lit(monday)))
    return rows.select("week_start", F.round(_on_time() * 100, 2).alias("otif_rate")).orderBy("week_start")


def critical_sellers(sums: Sums, week: times.Day, top_n: int | None = reporting.CRITICAL_SELLERS) -> DataFrame:
    monday = times.monday_of(week)
    rows = route(sums, "week_start", "seller_id", "seller_state").where((F.col("week_start") == F.lit(monday)) & (F.col("n") >= 2))
    share = F.col("late") / F.col("n")
    worst = rows.orderBy(F.desc(share), "seller_id", "seller_state")
    if top_n is not None:
        worst = worst.limit(top_n)
    return worst.select(
        "seller_id", labels.text_or(F.col("seller_state")).alias("state"), F.col("n").alias("total"), "late",
        F.round(share * 100, 1).alias("delay_rate"),
        F.coalesce(F.round(mean_delay("late_"), 1), F.lit(0.0)).alias("avg_delay"),
        F.coalesce(F.round(numbers.per(F.col("cost"), F.col("cost_n")), 2), F.lit(0.0)).alias("avg_cost"),
    )
