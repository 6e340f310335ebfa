import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmark.functions import labels, times
from haulmark.operators import browse, reporting

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def seed(spark):
    """Thirty shipments: two sellers, two states, every third one late."""
    rows = [
        (
            f"order_{i:04d}", "seller_AAAA" if i < 20 else "seller_BBBB", "SP" if i < 15 else "RJ", None,
            ("electronics", "furniture")[i % 2], i % 3 == 0, float(i % 5), 10.0, 100.0, 200.0 + i,
            START + dt.timedelta(hours=12 * (i // 2)), None,
        )
        for i in range(30)
    ]
    ddl = (
        "order_id string, seller_id string, seller_state string, customer_state string, category_name string,"
        " is_late boolean, delay_days double, freight_value double, price double, distance_km double,"
        " purchase_timestamp timestamp_ntz, delivered_timestamp timestamp_ntz"
    )
    return spark.createDataFrame(rows, ddl).cache()


def ids(df):
    return [r.order_id for r in df.collect()]


def test_filters(seed):
    assert browse.filter_shipments(seed).count() == 30
    assert browse.filter_shipments(seed, state="sp").count() == 15
    assert browse.filter_shipments(seed, status="LATE").count() == 10
    assert browse.filter_shipments(seed, search="ORDER_000").count() == 10
    assert browse.filter_shipments(seed, search="bbbb", status="on_time", category="furniture").count() == 3
    day = browse.filter_shipments(seed, date_from="2024-01-02", date_to=dt.datetime(2024, 1, 3))
    assert day.count() == 6  # both ends included
    with pytest.raises(ValueError):
        browse.filter_shipments(seed, status="early")


def test_pages_cover_everything_once(seed):
    pages = [ids(browse.page_of(seed, page, 7)) for page in range(1, 7)]
    assert [len(p) for p in pages] == [7, 7, 7, 7, 2, 0]
    everything = [i for p in pages for i in p]
    assert sorted(everything) == sorted(ids(seed)) and everything[:2] == ["order_0028", "order_0029"]
    last = seed.where(F.col("order_id") == everything[6]).first()
    assert ids(browse.page_after(seed, last.purchase_timestamp, last.order_id, 7)) == pages[1]
    assert tuple(browse.page_totals(seed, 10).first()) == (30, 3)
    assert tuple(browse.page_totals(seed.limit(0), 10).first()) == (0, 0)
    with pytest.raises(ValueError):
        browse.page_of(seed, 1, 201)


def test_lookup_and_details(seed):
    row = browse.details(browse.found(browse.one_order(seed, "order_0003"), "order")).first()
    assert (row.customer_state, row.seller_state) == ("", "SP")
    with pytest.raises(LookupError):
        browse.found(browse.one_order(seed, "nope"), "order nope")


def test_export_is_sorted_with_headers(spark, seed, tmp_path):
    path = str(tmp_path / "export")
    browse.write_export(browse.filter_shipments(seed, state="SP"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns[:4] == ["order_id", "seller_id", "seller_state", "customer_state"]
    assert back.count() == 15


def test_report_of_a_week(seed):
    week = dt.date(2024, 1, 10)  # normalised to Monday the 8th
    metrics = reporting.week_metrics(seed, week).first()
    assert (metrics.total_shipments, metrics.late_count) == (2, 0)
    assert (metrics.otif_rate, metrics.avg_cost) == (100.0, 110.0)
    assert metrics.wow_delta == pytest.approx(100 - 100 * 18 / 28, abs=0.005)
    first = reporting.week_metrics(seed, "2024-01-01").first()
    assert first.wow_delta is None
    nothing = reporting.week_metrics(seed, "2020-01-06").first()
    assert (nothing.total_shipments, nothing.otif_rate, nothing.avg_delay_days, nothing.wow_delta) == (0, 0.0, 0.0, None)


def test_report_lists(seed):
    sellers = reporting.critical_sellers(seed, "2024-01-03").collect()
    assert [(r.seller_id, r.state, r.total, r.late, r.delay_rate) for r in sellers] == [
        ("seller_AAAA", "RJ", 5, 2, 40.0), ("seller_BBBB", "RJ", 8, 3, 37.5), ("seller_AAAA", "SP", 15, 5, 33.3),
    ]
    late = reporting.late_of_week(seed, "2024-01-01").collect()
    assert len(late) == 10 and late[0].delay_days == 4.0 and late[0].cust_state == "—"
    trend = reporting.week_otif_trend(seed, "2024-01-01", bounded=True).collect()
    assert [r.week_start for r in trend] == [dt.date(2024, 1, 1)]
    assert reporting.week_otif_trend(seed, "2024-01-01").count() == 2


def test_latest_date_falls_back(spark):
    empty = spark.createDataFrame([], "date date")
    row = reporting.latest_data_date(empty, dt.date(2024, 12, 30)).first()
    assert (row.date, row.iso_week) == (dt.date(2024, 12, 30), "2025-W01")


def test_labels_and_times(spark):
    row = spark.range(1).select(
        labels.shorten(F.lit("abcdefghijklmnopqrst"), 16).alias("cut"),
        labels.risk_level(F.lit(0.8)).alias("edge"),
        labels.risk_level(F.lit(0.65)).alias("low_edge"),
        labels.delay_rate_band(F.lit(0.4)).alias("band"),
        times.days_until(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).alias("left"),
    ).first()
    assert tuple(row) == ("abcdefghijklmnop…", "medium", "medium", "amber", -1)
