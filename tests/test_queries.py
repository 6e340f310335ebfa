import re

import pytest

from checks.compare import compare, connect
from checks.oracles import ORACLES
from haulmark.plans.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def plan(spark, name):
    return REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kpi_summary", "shipments_enriched", "seller_profile", "flagged_shipments", "weekly_otif_trend"])
def test_no_python_workers_and_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_filters_and_columns_reach_the_scan(spark, sample, tmp_path):
    from haulmark.operators import reporting

    path = str(tmp_path / "shipments")
    priced = sample.withColumn("price", sample.freight_value)
    priced.write.parquet(path)
    report = reporting.critical_sellers(spark.read.schema(priced.schema).parquet(path), "2024-01-03")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = report._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(purchase_timestamp" in text and "LessThan(purchase_timestamp" in text
    assert "distance_km" not in text and "category_name" not in text


def test_unused_joins_disappear(spark):
    # The on-time share needs neither items, payments nor reviews.
    assert "l_extendedprice" not in plan(spark, "otif")
