"""Coordinates, distance, calendar, seller history and cost features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import numbers, times
from haulmark.functions.geodesy import add_geodesic_km
from haulmark.operators.lookups import lookup_derived
from haulmark.staging import stage

COORDINATES = ["seller_lat", "seller_lng", "customer_lat", "customer_lng"]


def zip_coordinates(geolocation: DataFrame) -> DataFrame:
    """One coordinate per zip prefix: the smallest complete pair."""
    point = F.struct(F.col("geolocation_lat").alias("lat"), F.col("geolocation_lng").alias("lng"))
    complete = F.col("geolocation_lat").isNotNull() & F.col("geolocation_lng").isNotNull()
    return (
        geolocation.where(complete & F.col("geolocation_zip_code_prefix").isNotNull())
        .groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"))
        .agg(F.min(point).alias("_point"))
        .select("zip_code_prefix", "_point.lat", "_point.lng")
    )


def with_coordinates(df: DataFrame, zips: DataFrame, role: str, spread_by: str) -> DataFrame:
    """Add ``{role}_lat`` and ``{role}_lng`` by ``{role}_zip_code_prefix``.

    Works on a fact or, cheaper, on the seller or customer table before it meets the facts.
    """
    key = f"{role}_zip_code_prefix"
    named = zips.select(
        F.col("zip_code_prefix").alias(key),
        F.col("lat").alias(f"{role}_lat"),
        F.col("lng").alias(f"{role}_lng"),
    )
    return lookup_derived(df, named, key, spread_by)


def with_distance(df: DataFrame) -> DataFrame:
    return add_geodesic_km(df, "seller_lat", "seller_lng", "customer_lat", "customer_lng", "distance_km")


def with_calendar(df: DataFrame) -> DataFrame:
    purchased = F.col("purchase_timestamp")
    return df.withColumns({"day_of_week": times.day_of_week(purchased), "month": times.month(purchased)})


def seller_delay_rates(df: DataFrame, among: Column | None = None) -> DataFrame:
    """Late share per seller, of the rows that are ``among`` if given, and the seller's number of rows (``n``)."""
    counted = F.coalesce(among, F.lit(False)) if among is not None else F.lit(True)
    rate = numbers.per(F.count_if(counted & F.col("is_late")), F.count_if(counted))
    return (
        df.where(F.col("seller_id").isNotNull())
        .groupBy("seller_id")
        .agg(rate.alias("seller_historical_delay_rate"), F.count(F.lit(1)).alias("n"))
    )


def with_rates(df: DataFrame, rates: DataFrame) -> DataFrame:
    """Attach stored seller rates (``seller_delay_rates`` of these rows); their counts tell the heavy sellers."""
    return lookup_derived(df, rates.drop("n"), "seller_id", "order_id", rates.select("seller_id", "n"))


def with_seller_delay_rate(df: DataFrame) -> DataFrame:
    """Late share of the seller over all given rows.

    An aggregate joined back, not a window: a window would pull all rows of a big seller into
    one task.
    """
    return with_rates(df, stage(seller_delay_rates(df), "seller-rates"))


def with_past_delay_rate(df: DataFrame) -> DataFrame:
    """Late share of the seller's deliveries on earlier days only (no look-ahead).

    Rows collapse to one per seller and day before the running total, so the window of even a
    very large seller holds at most one row per calendar day.
    """
    day = F.to_date("delivered_timestamp")
    daily = (
        df.where(F.col("seller_id").isNotNull() & day.isNotNull())
        .groupBy("seller_id", day.alias("_day"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("is_late")).alias("_late"))
    )
    earlier = W.partitionBy("seller_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    rate = F.try_divide(F.sum("_late").over(earlier).cast("double"), F.sum("_n").over(earlier))
    history = daily.select(
        F.struct("seller_id", "_day").alias("_seller_day"), rate.alias("seller_past_delay_rate"), F.col("_n").alias("n")
    )
    history = stage(history, "seller-days")
    keyed = df.withColumn(
        "_seller_day",
        F.when(F.col("seller_id").isNotNull() & day.isNotNull(), F.struct("seller_id", day.alias("_day"))),
    )
    weights = history.select("_seller_day", "n")
    return lookup_derived(keyed, history.drop("n"), "_seller_day", "order_id", weights).drop("_seller_day")


def with_cost_per_km(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_per_km", numbers.cost_per_km(F.col("freight_value"), F.col("distance_km")))


def enrich(df: DataFrame, geolocation: DataFrame) -> DataFrame:
    """Add every feature to a cleaned frame that carries both zip prefixes."""
    zips = zip_coordinates(geolocation)
    return (
        df.transform(with_coordinates, zips, "seller", "order_id")
        .transform(with_coordinates, zips, "customer", "order_id")
        .transform(with_distance)
        .transform(with_calendar)
        .transform(with_seller_delay_rate)
        .transform(with_cost_per_km)
    )


def located(table: DataFrame, zips: DataFrame, role: str) -> DataFrame:
    """A seller or customer table with state, zip prefix and coordinates."""
    key = f"{role}_id"
    columns = table.select(key, f"{role}_zip_code_prefix", f"{role}_state")
    return with_coordinates(columns, zips, role, key)
