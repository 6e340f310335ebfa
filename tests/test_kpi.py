import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmark.operators import aggregates, audit, kpi
from tests.conftest import KPI_DDL, WEEK_1, kpi_rows


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_headline_rates(sample, sample_all):
    assert only(kpi.otif(sample)).otif_rate == pytest.approx(100 * 86 / 110)
    assert only(kpi.avg_delay(sample)).avg_delay_days == pytest.approx(5.0)
    assert only(kpi.avg_delay(sample, only_late=False)).avg_delay_days == pytest.approx((24 * 5 - 86 * 2) / 110)
    assert only(kpi.fulfillment_rate(sample_all)).fulfillment_rate == pytest.approx(100 * 110 / 120)
    assert only(kpi.cost_per_shipment(sample)).avg_cost_per_shipment == pytest.approx(10.0)


@pytest.mark.parametrize(("late", "expected"), [(False, 100.0), (True, 0.0)])
def test_otif_extremes(spark, late, expected):
    rows = kpi_rows(50, "seller_A", "SP", "electronics", WEEK_1, late)
    assert only(kpi.otif(spark.createDataFrame(rows, KPI_DDL))).otif_rate == expected


def test_empty_input_is_null_or_refused(sample):
    empty = sample.limit(0)
    assert only(kpi.otif(empty)).otif_rate is None
    with pytest.raises(ValueError, match="must not be empty"):
        audit.require_rows(empty, "df")


def test_grouped_delay_leaves_out_groups_without_late_rows(spark, sample):
    punctual = spark.createDataFrame(kpi_rows(3, "seller_C", "SP", "toys", WEEK_1, False), KPI_DDL)
    grouped = kpi.avg_delay(sample.unionByName(punctual), group_by="seller_id")
    assert grouped.columns == ["seller_id", "avg_delay_days"]
    assert {r.seller_id: r.avg_delay_days for r in grouped.collect()} == {"seller_A": 5.0, "seller_B": 5.0}


def test_weekly_trend_fills_gaps_before_the_latest_week(sample):
    trend = kpi.weekly_otif_trend(sample, weeks=4).collect()
    assert [r.week_start for r in trend] == [dt.date(2023, 12, 18) + dt.timedelta(days=7 * i) for i in range(4)]
    assert [r.otif_rate for r in trend[:2]] == [None, None]
    assert [r.otif_rate for r in trend[2:]] == pytest.approx([100 * 50 / 60, 72.0])


def test_categories_and_scorecard(sample):
    categories = kpi.delay_by_category(sample).collect()
    assert {(r.category_name, r.avg_delay_days, r.order_count) for r in categories} == {
        ("electronics", 5.0, 70), ("furniture", 5.0, 40),
    }
    card = kpi.seller_scorecard(sample).collect()
    assert [(r.seller_id, r.seller_state, r.total_orders, r.delay_rate) for r in card] == [
        ("seller_B", "RJ", 40, 0.25), ("seller_A", "SP", 70, 0.2),
    ]


def test_scorecard_ranking_arguments(sample):
    assert kpi.ranked_scorecard(sample, sort_by="total_orders", limit=1).first().seller_id == "seller_A"
    assert kpi.ranked_scorecard(sample, sort_by="nonsense", limit=1).first().seller_id == "seller_B"
    with pytest.raises(ValueError):
        kpi.ranked_scorecard(sample, limit=501)


def test_summary(sample, sample_all):
    row = only(kpi.kpi_summary(sample, sample_all)).asDict()
    assert row == {
        "otif_rate": 78.1818, "avg_delay_days": 5.0, "fulfillment_rate": 91.6667, "avg_cost_per_shipment": 10.0,
        "total_shipments": 110, "late_shipments": 24, "week_over_week_otif_delta": -11.3333,
    }
    one_week = only(kpi.kpi_summary(sample.where(F.col("purchase_timestamp") < "2024-01-05"), sample_all))
    assert one_week.week_over_week_otif_delta is None
    zeros = only(kpi.kpi_summary_or_zero(sample.limit(0), sample_all))
    assert (zeros.otif_rate, zeros.total_shipments, zeros.week_over_week_otif_delta) == (0.0, 0, None)


def test_wow_skips_weeks_without_data(spark, sample):
    later = spark.createDataFrame(kpi_rows(4, "seller_A", "SP", "toys", dt.datetime(2024, 1, 29), False), KPI_DDL)
    delta = only(kpi.wow_otif_delta(sample.unionByName(later))).week_over_week_otif_delta
    assert delta == pytest.approx(28.0)


def test_maintained_aggregates(sample):
    daily = {r.date: r for r in aggregates.kpi_daily(sample).collect()}
    assert daily[dt.date(2024, 1, 1)].otif_rate == pytest.approx(50 / 60)
    assert daily[dt.date(2024, 1, 8)].total_shipments == 50
    stats = {r.seller_id: r for r in aggregates.seller_stats(sample).collect()}
    assert stats["seller_A"].avg_delay_days == pytest.approx((14 * 5 - 56 * 2) / 70)
    assert only(aggregates.load_summary(sample)).asDict() == {"shipments": 110, "kpi_days": 2, "sellers": 2}


def test_seller_profile_ends_at_the_sellers_own_week(sample):
    stats = aggregates.seller_stats(sample)
    rows = kpi.seller_profile(stats, sample, "seller_B").orderBy("week_start").collect()
    assert len(rows) == 8 and rows[-1].week_start == dt.date(2024, 1, 8)
    assert rows[-1].otif_rate == pytest.approx(75.0)


def test_result_ranges(sample, sample_all):
    checks = audit.result_violations(kpi.kpi_summary(sample, sample_all)).collect()
    assert len(checks) == 5 and all(r.violations == 0 for r in checks)
