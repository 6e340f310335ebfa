"""Display bands and text shaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: band limits and display widths. ---------------------------------------
HIGH_RISK_ABOVE = 0.8
MEDIUM_RISK_FROM = 0.65
RATE_RED_ABOVE = 0.4
RATE_AMBER_FROM = 0.2
DAYS_RED_ABOVE = 5
DAYS_AMBER_FROM = 2
CATEGORY_LABEL_WIDTH = 22
MISSING_TEXT = "—"


def risk_level(probability: Column) -> Column:
    return (
        F.when(probability > HIGH_RISK_ABOVE, "high")
        .when(probability >= MEDIUM_RISK_FROM, "medium")
        .otherwise("low")
    )


def delay_rate_band(rate: Column) -> Column:
    return F.when(rate > RATE_RED_ABOVE, "red").when(rate >= RATE_AMBER_FROM, "amber").otherwise("green")


def delay_days_band(days: Column) -> Column:
    return F.when(days > DAYS_RED_ABOVE, "red").when(days >= DAYS_AMBER_FROM, "amber").otherwise("green")


def shorten(text: Column, width: int) -> Column:
    """Keep ``width`` characters and mark a cut with an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def text_or(text: Column, default: str = MISSING_TEXT) -> Column:
    """Missing and empty text become ``default``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def category_label(name: Column) -> Column:
    return F.substring(F.replace(name, F.lit("_"), F.lit(" ")), 1, CATEGORY_LABEL_WIDTH)
