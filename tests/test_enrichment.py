import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmark.functions.geodesy import add_geodesic_km
from haulmark.operators import enrichment
from haulmark.sources import csv_files

# Published geodesic lengths on WGS-84, the hard ones nearly antipodal.
KNOWN = [
    (41.49008, -71.312796, 41.499498, -81.695391, 866.455432910),
    (0.0, 0.0, 0.5, 179.5, 19936.288578965),
    (0.0, 0.0, 0.5, 179.7, 19944.127421),
    (-30.0, 0.0, 29.9, 179.8, 19989.832827),
    (0.0, 0.0, 0.0, 180.0, 20003.931458),
    (90.0, 0.0, -90.0, 0.0, 20003.931458),
    (0.0, 0.0, 90.0, 0.0, 10001.965729),
    (0.0, 0.0, 0.0, 10.0, 1113.194908),
    (10.0, 20.0, 10.0, 20.0, 0.0),
    (5.0, -179.0, 5.0, 179.0, 221.797327),
]


def distances(spark, points):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, x double, b double, y double")
    return [r.km for r in add_geodesic_km(df, "a", "x", "b", "y", "km").orderBy("i").collect()]


def test_published_distances(spark):
    assert distances(spark, [p[:4] for p in KNOWN]) == pytest.approx([p[4] for p in KNOWN], abs=2e-6)


def test_unusable_points(spark):
    nan, inf = float("nan"), float("inf")
    points = [(None, 0.0, 0.0, 0.0), (95.0, 0.0, 0.0, 0.0), (nan, 0.0, 0.0, 0.0), (0.0, inf, 0.0, 0.0), (0.0, nan, 0.0, 0.0)]
    assert distances(spark, points) == [None] * 5


def test_distance_can_be_filtered_without_plan_growth(spark):
    df = spark.range(50).select((F.col("id") - 25.0).alias("a"), F.lit(0.0).alias("x"))
    far = add_geodesic_km(df, "a", "x", "x", "x", "km").where(F.col("km") > 1000).where(F.col("km").isNotNull())
    assert len(far._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert far.count() == 16 + 15


def test_enrich_from_files(spark, sources):
    from haulmark.operators.cleaning import clean_shipments
    from haulmark.plans.shipments import enriched_shipments

    chained = enrichment.enrich(clean_shipments(sources, csv_files.ORDINAL), sources["geolocation"])
    planned = enriched_shipments(sources, csv_files.ORDINAL)
    assert sorted(chained.columns) == sorted(planned.columns)
    rows = {r.order_id: r.asDict() for r in chained.collect()}
    assert rows == {r.order_id: r.asDict() for r in planned.collect()}
    first = rows["o1"]
    assert (first["seller_lat"], first["seller_lng"]) == (-23.55, -46.63)  # the smaller of two points
    assert first["distance_km"] == pytest.approx(358.17, abs=0.5)
    assert first["cost_per_km"] == pytest.approx(4.0 / first["distance_km"])
    assert first["seller_historical_delay_rate"] == 0.5
    assert (first["day_of_week"], first["month"]) == (1, 1)
    assert rows["o2"]["distance_km"] is None and rows["o4"]["seller_historical_delay_rate"] is None


def test_zero_distance_has_no_cost_per_km(spark):
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (5.0, 2.0)], "freight_value double, distance_km double")
    assert [r.cost_per_km for r in enrichment.with_cost_per_km(df).collect()] == [None, None, 2.5]


def test_hot_seller_keeps_every_row(spark):
    df = spark.range(30_000).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("seller_id"),
        (F.col("id") % 6 == 0).alias("is_late"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(days=(F.col("id") % 30).cast("int")))
        .cast("timestamp_ntz").alias("delivered_timestamp"),
    )
    rated = enrichment.with_seller_delay_rate(df)
    hot = rated.where("seller_id = 'hot'").agg(F.count("*").alias("n"), F.avg("seller_historical_delay_rate").alias("r"))
    assert rated.count() == 30_000
    assert tuple(hot.first()) == (10_000, pytest.approx(0.5))
    past = enrichment.with_past_delay_rate(df).where("seller_id = 'hot'").orderBy("delivered_timestamp")
    assert past.count() == 10_000 and past.first().seller_past_delay_rate is None


def test_past_rate_ignores_the_same_day(spark):
    rows = [("a", "s", True, 1), ("b", "s", False, 1), ("c", "s", False, 2), ("d", "s", True, None), ("e", None, True, 2)]
    df = spark.createDataFrame(
        [(o, s, late, None if d is None else dt.datetime(2024, 1, d, 12)) for o, s, late, d in rows],
        "order_id string, seller_id string, is_late boolean, delivered_timestamp timestamp_ntz",
    )
    got = {r.order_id: r.seller_past_delay_rate for r in enrichment.with_past_delay_rate(df).collect()}
    assert got == {"a": None, "b": None, "c": 0.5, "d": None, "e": None}
