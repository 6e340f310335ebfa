"""Scoring of shipments and the alerts drawn from it.

A scorer is any function that adds ``delay_probability`` to a frame.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.functions import labels, times
from haulmark.operators.audit import input_violations
from haulmark.schemas import ACTIVE_STATUSES, DEFAULT_THRESHOLD, FLAGGED_COLUMNS

Scorer = Callable[[DataFrame], DataFrame]


def predict_batch(df: DataFrame, scorer: Scorer, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    scored = scorer(df)
    return scored.withColumn("predicted_late", F.col("delay_probability") >= F.lit(threshold))


def active_only(df: DataFrame) -> DataFrame:
    """Rows still under way; without a status column every row counts as such."""
    if "order_status" not in df.columns:
        return df
    return df.where(F.lower("order_status").isin(ACTIVE_STATUSES))


def flagged_shipments(
    df: DataFrame,
    scorer: Scorer,
    as_of: dt.datetime | str,
    threshold: float = DEFAULT_THRESHOLD,
    limit: int | None = None,
) -> DataFrame:
    """Active shipments at or above the threshold, riskiest first, in a fixed layout."""
    flagged = predict_batch(active_only(df), scorer, threshold).where("predicted_late")
    if "days_until_delivery" not in flagged.columns and "estimated_delivery" in flagged.columns:
        now = F.lit(str(as_of)).cast("timestamp_ntz")
        left = times.days_until(F.col("estimated_delivery").cast("timestamp_ntz"), now)
        flagged = flagged.withColumn("days_until_delivery", left)
    ranked = flagged.select(
        *[(F.col(name) if name in flagged.columns else F.lit(None)).cast(kind).alias(name) for name, kind in FLAGGED_COLUMNS]
    ).orderBy(F.desc_nulls_last("delay_probability"), "order_id")
    return ranked if limit is None else ranked.limit(limit)


def alert_stats(flagged: DataFrame) -> DataFrame:
    level = labels.risk_level(F.col("delay_probability"))
    return flagged.agg(
        F.count(F.lit(1)).alias("total_flagged"),
        F.count_if(level == "high").alias("high_risk"),
        F.count_if(level == "medium").alias("medium_risk"),
        F.coalesce(F.avg("delay_probability"), F.lit(0.0)).alias("avg_probability"),
    )


def with_risk(scored: DataFrame) -> DataFrame:
    return scored.withColumn("risk_level", labels.risk_level(F.col("delay_probability")))


def of_risk(scored: DataFrame, level: str) -> DataFrame:
    return with_risk(scored).where(F.col("risk_level") == level.lower())


def with_prediction(df: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Shipments with ``prediction_probability``; NULL while there is no model."""
    if scorer is None:
        return df.withColumn("prediction_probability", F.lit(None).cast("double"))
    return scorer(df).withColumnRenamed("delay_probability", "prediction_probability")


def score_requests(
    requests: DataFrame, scorer: Scorer, threshold: float = DEFAULT_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """Answers for valid requests, and the invalid ones with their violations."""
    checked = input_violations(requests)
    valid = checked.where(F.size("violations") == 0).drop("violations")
    answered = with_risk(predict_batch(valid, scorer, threshold))
    return answered, checked.where(F.size("violations") > 0)
