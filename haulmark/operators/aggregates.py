"""Aggregates that are kept as tables beside the shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions import numbers, times


def kpi_daily(shipments: DataFrame) -> DataFrame:
    """One row per UTC purchase date. Every input row is delivered, so fulfilment is 1."""
    day = times.utc_date(F.col("purchase_timestamp"))
    return (
        shipments.where(F.col("purchase_timestamp").isNotNull())
        .groupBy(day.alias("date"))
        .agg(
            numbers.share(~F.col("is_late")).alias("otif_rate"),
            numbers.mean(F.col("delay_days")).alias("avg_delay_days"),
            F.lit(1.0).alias("fulfillment_rate"),
            numbers.mean(F.col("freight_value")).alias("avg_cost_per_shipment"),
            F.count("order_id").alias("total_shipments"),
            F.lit(0).cast("bigint").alias("flagged_count"),
        )
    )


def seller_sums(shipments: DataFrame) -> DataFrame:
    """Additive figures per seller, plus its state.

    The state is a grouping key of the first, map-side step: an aggregate over text would
    force Spark to sort all rows instead of hashing them. The second step sees one row per
    seller and state.
    """
    late = F.col("is_late")
    freight = F.col("freight_value")
    parts = (
        shipments.where(F.col("seller_id").isNotNull())
        .groupBy("seller_id", "seller_state")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if(late).alias("late"),
            F.sum("delay_days").alias("delay"),
            F.count("delay_days").alias("delay_n"),
            F.sum(F.when(late, F.col("delay_days"))).alias("late_delay"),
            F.count(F.when(late, F.col("delay_days"))).alias("late_delay_n"),
            F.sum(freight).alias("freight"),
            F.count(freight).alias("freight_n"),
        )
    )
    sums = [name for name in parts.columns if name not in ("seller_id", "seller_state")]
    return parts.groupBy("seller_id").agg(
        F.min("seller_state").alias("seller_state"), *[F.sum(name).alias(name) for name in sums]
    )


def seller_stats(shipments: DataFrame) -> DataFrame:
    """One row per seller; the delay is averaged over all its orders, late or not."""
    return seller_sums(shipments).select(
        "seller_id",
        "seller_state",
        F.col("orders").alias("total_orders"),
        numbers.per(F.col("late"), F.col("orders")).alias("delay_rate"),
        numbers.per(F.col("delay"), F.col("delay_n")).alias("avg_delay_days"),
        numbers.per(F.col("freight"), F.col("freight_n")).alias("avg_cost"),
    )


def load_summary(shipments: DataFrame) -> DataFrame:
    """Row, day and seller counts of a load.

    Rows first shrink to (day, seller) pairs, so the distinct counts see pre-aggregated input.
    """
    day = times.utc_date(F.col("purchase_timestamp"))
    pairs = shipments.groupBy(day.alias("_day"), "seller_id").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("shipments"),
        F.countDistinct("_day").alias("kpi_days"),
        F.countDistinct("seller_id").alias("sellers"),
    )
