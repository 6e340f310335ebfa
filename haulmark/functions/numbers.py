"""Rounding, ratio and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column) -> Column:
    """Two-decimal amount; unreadable or missing amounts become 0, those that do not fit become NULL."""
    number = value.try_cast("double")
    unreadable = number.isNull() | F.isnan(number)
    return F.when(unreadable, F.lit(0).cast("decimal(18,2)")).otherwise(value.try_cast("decimal(18,2)"))


def mean(value: Column, where: Column | None = None) -> Column:
    """Mean as a double from an exact sum; NULL when nothing qualifies."""
    picked = value if where is None else F.when(where, value)
    return per(F.sum(picked), F.count(picked))


def share(condition: Column) -> Column:
    """Fraction of the group's rows that satisfy ``condition``; NULL for no rows."""
    return per(F.count_if(condition), F.count(F.lit(1)))


def percent(condition: Column) -> Column:
    return share(condition) * 100


def per(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(per(numerator, denominator), F.lit(0.0))


def cost_per_km(freight: Column, distance: Column) -> Column:
    """NULL without a distance and for a zero distance."""
    return per(freight, distance)


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
