"""What plans read, move and reuse."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from haulmark.operators import cleaning, lookups, registry
from haulmark.plans.catalog import REGISTRY
from haulmark.schemas import MODEL_VERSIONS, SOURCE_FILES
from haulmark.sources import csv_files, star

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, had)


def test_products_are_not_shuffled_by_category(spark, no_broadcast, monkeypatch):
    sources = star.StarSources(spark, FOLDER)
    named = cleaning.english_categories(sources["products"], sources["category_translation"])
    assert "hashpartitioning(product_category_name" not in plan(named) and "BroadcastHashJoin" in plan(named)
    want = sorted(map(str, named.collect()))
    monkeypatch.setattr(lookups, "SMALL_ROWS", 2)
    long = cleaning.english_categories(sources["products"], sources["category_translation"])
    assert "hashpartitioning(product_category_name" in plan(long) and sorted(map(str, long.collect())) == want


@pytest.mark.parametrize("name", ["shipments_late", "shipments_date_range", "shipment_lookup", "shipments_export", "unscored_listing"])
def test_listings_read_no_history(spark, no_broadcast, name):
    found = plan(REGISTRY[name](spark, FOLDER))
    # Items: their first one, payments, reviews are left out, and the first shipping date that the star adapter derives.
    assert len(re.findall(r"Location: InMemoryFileIndex[^\n]*lineitem", found)) <= 2 or found.count("lineitem") <= 2
    assert "count_if" not in found and "seller_historical_delay_rate" not in found


def test_versions_are_read_once(spark, tmp_path):
    shipments = "order_id string, created_at timestamp_ntz, purchase_timestamp timestamp_ntz, is_late boolean"
    spark.createDataFrame([], shipments).write.parquet(f"{tmp_path}/shipments")
    rows = spark.read.schema(shipments).parquet(f"{tmp_path}/shipments")
    registry.append_rows(
        spark, f"{tmp_path}/versions", MODEL_VERSIONS,
        [("v1", dt.datetime(2024, 1, 1), 0.9, 0.5, 0.5, 0.5, 0.65, True, "p", None)],
    )
    versions = registry.read_versions(spark, str(tmp_path))
    decided = registry.retrain_decision(rows, versions, "2024-02-01 00:00:00")
    assert plan(decided).count("FileScan") == 1 and "Subquery" not in plan(decided)
    assert (decided.first().active_version, decided.first().reason) == ("v1", "no_recent_rows")


def test_files_without_line_breaks_are_split(spark, tmp_path):
    path = tmp_path / f"{SOURCE_FILES['order_reviews']}.csv"
    path.write_text("review_id,order_id,review_score\n" + "".join(f"r{i},o{i},{i % 5}\n" for i in range(20_000)))
    name = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        split = csv_files.read_table(spark, str(tmp_path), "order_reviews", multi_line=False)
        whole = csv_files.read_table(spark, str(tmp_path), "order_reviews")
        tasks = [df.select(F.spark_partition_id()).distinct().count() for df in (split, whole)]
        assert tasks[0] > 3 and tasks[1] == 1
        assert split.count() == whole.count() == 20_000
    finally:
        spark.conf.set(name, had)
