"""Weekly report figures over the half-open week that starts on a Monday."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions import labels, numbers, times
from haulmark.operators.browse import within

WEEK = dt.timedelta(days=7)

# --- Fixed values: list sizes and text widths of the report. -----------------------------
CRITICAL_SELLERS = 5
FLAGGED_ROWS = 200
CATEGORY_CUT = 24


def week_metrics(shipments: DataFrame, week: times.Day) -> DataFrame:
    """Headline figures of the week and the change against the calendar week before.

    One scan of fourteen days. ``on_time_share`` is one minus the late share.
    """
    monday = times.monday_of(week)
    now = F.col("purchase_timestamp") >= times.time_literal(shipments, "purchase_timestamp", monday)
    late = F.col("is_late")
    cost = F.col("freight_value") + F.col("price")
    sums = within(shipments, monday - WEEK, monday + WEEK).agg(
        F.count_if(now).alias("total"),
        F.count_if(now & late).alias("late"),
        numbers.mean(F.col("delay_days"), where=now).alias("delay"),
        numbers.mean(cost, where=now).alias("cost"),
        F.count_if(~now).alias("prior"),
        F.count_if(~now & late).alias("prior_late"),
    )
    return metrics_of(sums)


def metrics_of(sums: DataFrame) -> DataFrame:
    """The headline figures from the sums of a week and of the one before."""
    share = numbers.ratio_or_zero(F.col("total") - F.col("late"), F.col("total"))
    prior_share = numbers.per(F.col("prior") - F.col("prior_late"), F.col("prior"))
    return sums.select(
        F.round(share * 100, 2).alias("otif_rate"),
        F.round(F.coalesce("delay", F.lit(0.0)), 2).alias("avg_delay_days"),
        F.round(F.coalesce("cost", F.lit(0.0)), 2).alias("avg_cost"),
        F.round(share * 100, 2).alias("on_time_share"),
        F.col("total").alias("total_shipments"),
        F.col("late").alias("late_count"),
        F.round((share - prior_share) * 100, 2).alias("wow_delta"),
    )


def week_otif_trend(shipments: DataFrame, week: times.Day, weeks: int = 8, bounded: bool = False) -> DataFrame:
    """Weeks with shipments from ``weeks - 1`` weeks before on; later weeks too unless ``bounded``."""
    monday = times.monday_of(week)
    since = monday - WEEK * (weeks - 1)
    if bounded:
        rows = within(shipments, since, monday + WEEK)
    else:
        start = times.time_literal(shipments, "purchase_timestamp", since)
        rows = shipments.where(F.col("purchase_timestamp") >= start)
    return (
        rows.groupBy(times.week_start(F.col("purchase_timestamp")).alias("week_start"))
        .agg(F.round(numbers.percent(~F.col("is_late")), 2).alias("otif_rate"))
        .orderBy("week_start")
    )


def critical_sellers(shipments: DataFrame, week: times.Day, top_n: int | None = CRITICAL_SELLERS) -> DataFrame:
    """Sellers with at least two orders in the week, highest late share first; all of them without ``top_n``."""
    monday = times.monday_of(week)
    delay = F.col("delay_days")
    grouped = (
        within(shipments, monday, monday + WEEK)
        .groupBy("seller_id", "seller_state")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_late").alias("late"),
            F.round(numbers.mean(delay, where=delay > 0), 1).alias("avg_delay"),
            F.round(numbers.mean(F.col("freight_value") + F.col("price")), 2).alias("avg_cost"),
        )
        .where(F.col("total") >= 2)
    )
    worst = grouped.orderBy(F.desc(F.col("late") / F.col("total")), "seller_id", "seller_state")
    if top_n is not None:
        worst = worst.limit(top_n)
    return worst.select(
        "seller_id",
        labels.text_or(F.col("seller_state")).alias("state"),
        "total",
        "late",
        F.round(F.col("late") / F.col("total") * 100, 1).alias("delay_rate"),
        F.coalesce("avg_delay", F.lit(0.0)).alias("avg_delay"),
        F.coalesce("avg_cost", F.lit(0.0)).alias("avg_cost"),
    )


def late_of_week(shipments: DataFrame, week: times.Day, limit: int | None = FLAGGED_ROWS) -> DataFrame:
    """The week's late shipments, longest delay first; all of them without ``limit``."""
    monday = times.monday_of(week)
    rows = within(shipments, monday, monday + WEEK).where(F.col("is_late"))
    worst = rows.orderBy(F.desc_nulls_last("delay_days"), "order_id")
    if limit is not None:
        worst = worst.limit(limit)
    return worst.select(
        "order_id",
        "seller_id",
        labels.text_or(F.col("seller_state")).alias("seller_state"),
        labels.text_or(F.col("customer_state")).alias("cust_state"),
        F.substring(labels.text_or(F.col("category_name")), 1, CATEGORY_CUT).alias("category"),
        F.coalesce("delay_days", F.lit(0.0)).alias("delay_days"),
        (F.col("freight_value") + F.col("price")).cast("double").alias("total_value"),
    )


def latest_data_date(daily: DataFrame, fallback: dt.date | None = None) -> DataFrame:
    """Newest day of the daily table, its Monday and ISO week label."""
    newest = F.coalesce(F.max("date"), F.lit(fallback).cast("date"))
    monday = times.week_start(F.col("date"))
    return daily.agg(newest.alias("date")).select(
        "date",
        monday.alias("week_start"),
        times.week_end(monday).alias("week_end"),
        times.iso_week_label(F.col("date")).alias("iso_week"),
    )
