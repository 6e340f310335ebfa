"""Counts that show what cleaning and enrichment did to the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions import numbers, times
from haulmark.operators.enrichment import COORDINATES

REQUIRED = ["order_id", "customer_id", "seller_id", "price", "freight_value", "is_late"]

# --- Fixed values: accepted ranges of scoring inputs and of KPI results. ------------------
INPUT_RANGES = {
    "distance_km": (0, None),
    "day_of_week": (0, 6),
    "month": (1, 12),
    "freight_value": (0, None),
    "price": (0, None),
    "seller_historical_delay_rate": (0, 1),
}
INPUT_DEFAULTS = {"month": 1, "seller_historical_delay_rate": 0.1}
RESULT_RANGES = {
    "otif_rate": (0, 100),
    "fulfillment_rate": (0, 100),
    "avg_cost_per_shipment": (0, None),
    "total_shipments": (0, None),
    "late_shipments": (0, None),
    "order_count": (0, None),
    "total_orders": (0, None),
    "delay_rate": (0, 1),
    "avg_cost": (0, None),
}


def require_rows(df: DataFrame, label: str = "DataFrame") -> DataFrame:
    """Fail on empty input. Costs one small job, so operators only do it when asked to."""
    if df.isEmpty():
        raise ValueError(f"{label} must not be empty.")
    return df


def order_audit(raw_orders: DataFrame, order_by: list[str]) -> DataFrame:
    """Rows before and after key checks, deduplication and the status filter.

    Copies collapse to one row per order first: their number, and whether the copy that
    keep-first retains under the same ``order_by`` was delivered.
    """
    delivered = F.col("order_status") == "delivered"
    keyed = raw_orders.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(delivered, F.struct(*order_by)).alias("_delivered")
    )
    has_key = F.col("order_id").isNotNull()
    return keyed.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(~has_key, F.col("_n"))), F.lit(0)).alias("null_key_rows"),
        F.coalesce(F.sum(F.when(has_key, F.col("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(has_key).alias("orders"),
        F.count_if(has_key & F.col("_delivered")).alias("delivered_orders"),
    ).withColumn(
        "delivered_pct", F.round(100 * numbers.ratio_or_zero(F.col("delivered_orders"), F.col("orders")), 6)
    )


def late_audit(shipments: DataFrame) -> DataFrame:
    return shipments.agg(
        F.count(F.lit(1)).alias("delivered_rows"),
        F.count_if("is_late").alias("late_rows"),
        F.round(numbers.percent(F.col("is_late")), 6).alias("late_pct"),
    )


def coercion_audit(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column, values that were present but could not be read as a timestamp."""
    present = [name for name in columns if name in raw.columns]

    def lost(name: str):
        return F.count_if(F.col(name).isNotNull() & times.utc_timestamp(F.col(name)).isNull()).alias(name)

    counts = raw.agg(*[lost(name) for name in present])
    return counts.unpivot([], present, "column_name", "coerced_to_null")


def missing_coordinates(df: DataFrame) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in COORDINATES])
    return df.agg(F.count_if(missing).alias("missing_rows"), F.count_if(~missing).alias("located_rows"))


def _storable():
    return reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in REQUIRED])


def storable(shipments: DataFrame) -> DataFrame:
    """Rows that have every value the shipments table requires."""
    return shipments.where(_storable())


def rejected(shipments: DataFrame) -> DataFrame:
    """The complement of ``storable`` with the offending columns."""
    reasons = [F.when(F.col(name).isNull(), F.lit(name)) for name in REQUIRED]
    return shipments.where(~_storable()).withColumn("reject_reason", F.concat_ws(", ", *reasons))


def _violation(name: str, limits: tuple, nullable: bool):
    low, high = limits
    bad = F.col(name) < low
    if high is not None:
        bad = bad | (F.col(name) > high)
    return F.coalesce(bad, F.lit(not nullable))


def input_violations(requests: DataFrame) -> DataFrame:
    """Fill the two defaults and list, per scoring request, the fields out of range."""
    filled = requests.withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in INPUT_DEFAULTS.items()}
    )
    broken = [
        F.when(_violation(name, limits, nullable=False), F.lit(name)) for name, limits in INPUT_RANGES.items()
    ]
    broken += [F.when(F.col(name).isNull(), F.lit(name)) for name in ("category_name", "seller_state")]
    return filled.withColumn("violations", F.array_compact(F.array(*broken)))


def result_violations(result: DataFrame) -> DataFrame:
    """Per KPI column present in ``result``, the number of values out of range."""
    checked = {name: limits for name, limits in RESULT_RANGES.items() if name in result.columns}
    counts = result.agg(
        *[F.count_if(_violation(name, limits, nullable=True)).alias(name) for name, limits in checked.items()]
    )
    return counts.unpivot([], list(checked), "column_name", "violations")
