import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from haulmark.plans import jobs
from haulmark.schemas import SHIPMENTS
from haulmark.sources import csv_files
from haulmark.sources.stored import Snapshot, StoredTable, absent_columns, conform

FIRST, SECOND = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


@pytest.fixture
def table(spark, tmp_path):
    return jobs.shipments_table(spark, str(tmp_path))


def batch(spark, rows):
    return spark.createDataFrame(
        [(i, "c", "s", when, price, False) for i, when, price in rows],
        "order_id string, customer_id string, seller_id string, purchase_timestamp timestamp_ntz, price double, is_late boolean",
    )


def month(n):
    return dt.datetime(2017, n, 15)


def content(table):
    return {r.order_id: (r.purchase_timestamp.month, float(r.price), str(r.created_at)[:10]) for r in table.read().collect()}


def test_merge_inserts_replaces_and_repeats(spark, table):
    assert table.version() == 0 and table.read().count() == 0
    table.merge(batch(spark, [("a", month(1), 1.0), ("b", month(1), 2.0), ("c", month(3), 3.0)]), FIRST)
    update = batch(spark, [("b", month(1), 20.0), ("d", month(1), 4.0)])
    assert table.merge(update, SECOND) == 2
    expected = {
        "a": (1, 1.0, "2024-01-01"), "b": (1, 20.0, "2024-01-01"), "c": (3, 3.0, "2024-01-01"), "d": (1, 4.0, "2024-02-01"),
    }
    assert content(table) == expected
    table.merge(update, "2024-03-01 00:00:00")
    assert content(table) == expected


def test_untouched_months_are_not_rewritten(spark, table):
    table.merge(batch(spark, [("a", month(1), 1.0), ("c", month(3), 3.0)]), FIRST)
    before = table._parts(1)
    table.merge(batch(spark, [("b", month(1), 2.0)]), SECOND)
    after = table._parts(2)
    assert after["2017-03"] == before["2017-03"] and after["2017-01"] != before["2017-01"]
    assert table.read(["2017-03"]).count() == 1


def test_time_range_opens_only_its_months(spark, table):
    table.merge(batch(spark, [("a", month(1), 1.0), ("b", month(2), 2.0), ("c", month(3), 3.0)]), FIRST)
    found = table.between("2017-02-01", "2017-02-28 12:00:00")
    assert [r.order_id for r in found.collect()] == ["b"]
    assert len(found.inputFiles()) == 1 and "part=2017-02" in found.inputFiles()[0]
    assert table.between("2016-01-01", "2016-02-01").count() == 0


def test_files_are_sorted_by_seller(spark, table):
    rows = batch(spark, [(f"o{i:03d}", month(1), 1.0) for i in range(200)])
    table.merge(rows.withColumn("seller_id", F.format_string("s%d", F.hash("order_id") % 7)), FIRST)
    for file in table.read().inputFiles():
        sellers = [r.seller_id for r in spark.read.parquet(file).collect()]
        assert sellers == sorted(sellers)


def test_repeated_key_in_a_batch_is_refused(spark, table):
    with pytest.raises(ValueError, match="2 rows"):
        table.merge(batch(spark, [("a", month(1), 1.0), ("a", month(2), 2.0)]), FIRST)
    assert table.version() == 0


def test_key_that_moves_to_another_month(spark, table):
    table.merge(batch(spark, [("a", month(1), 1.0), ("b", month(2), 2.0)]), FIRST)
    table.merge(batch(spark, [("a", month(3), 9.0)]), SECOND)
    assert content(table) == {"a": (3, 9.0, "2024-01-01"), "b": (2, 2.0, "2024-01-01")}
    assert "2017-01" not in table._parts(table.version())


def test_row_without_a_time_is_kept(spark, table):
    table.merge(batch(spark, [("a", None, 1.0), ("b", month(2), 2.0)]), FIRST)
    assert table.read().count() == 2


def test_second_publisher_of_a_version_fails(spark, table):
    table.merge(batch(spark, [("a", month(1), 1.0)]), FIRST)
    with pytest.raises(RuntimeError, match="another merge"):
        table._publish(1, Snapshot())
    assert content(table) == {"a": (1, 1.0, "2024-01-01")}


def test_conform_fills_and_cleans(spark):
    df = spark.createDataFrame([("o", float("nan"))], "order_id string, delay_days double")
    row = conform(df, SHIPMENTS).first()
    assert row.delay_days is None and row.price is None and len(row) == len(SHIPMENTS)
    assert "price" in absent_columns(df, SHIPMENTS)


def test_unpartitioned_table(spark, tmp_path):
    columns = [("k", "string", False), ("v", "bigint", True)]
    table = StoredTable(spark, str(tmp_path / "t"), columns, "k", stamps=("updated_at",))
    table.merge(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint"), FIRST)
    table.merge(spark.createDataFrame([("b", 5)], "k string, v bigint"), SECOND)
    assert {r.k: (r.v, r.updated_at.month) for r in table.read().collect()} == {"a": (1, 1), "b": (5, 2)}


def test_jobs_end_to_end(spark, sources, tmp_path):
    root = str(tmp_path / "tables")
    summary = jobs.run_etl(spark, sources, csv_files.ORDINAL, root, FIRST)
    assert summary == {"shipments": 2, "kpi_days": 2, "sellers": 1}
    assert jobs.run_etl(spark, sources, csv_files.ORDINAL, root, SECOND) == summary
    stored = {r.order_id: r for r in jobs.shipments_table(spark, root).read().collect()}
    assert set(stored) == {"o1", "o2"} and str(stored["o1"].created_at)[:10] == "2024-01-01"
    assert [r.order_id for r in jobs.rejected_table(spark, root).read().collect()] == ["o4"]
    assert jobs.all_orders_table(spark, root).read().count() == 4
    assert [(r.order_id, r.seller_historical_delay_rate) for r in jobs.open_shipments_table(spark, root).read().collect()] == [("o3", 0.5)]
    folder = jobs.run_report(spark, root)
    assert folder.endswith("report/2018-W01")
    metrics = spark.read.option("header", True).csv(f"{folder}/metrics").first()
    assert (metrics.total_shipments, metrics.late_count) == ("2", "1")
    with pytest.raises(RuntimeError, match="no active model"):
        jobs.active_model(spark, root)
    nothing = jobs.run_retrain(spark, str(tmp_path / "empty"), FIRST)
    assert nothing == {"retrained": False, "new_f1": 0.0, "old_f1": 0.0, "promoted": False}


def shipments(spark, rows):
    ddl = "order_id string, seller_id string, purchase_timestamp timestamp_ntz, is_late boolean, price double"
    fixed = {"customer_id": F.lit("c"), "seller_state": F.lit("SP"), "freight_value": F.lit(2.0), "delay_days": F.lit(1.0)}
    return spark.createDataFrame(rows, ddl).withColumns(fixed)


def test_two_loads_add_up_to_one(spark, tmp_path):
    first = [("a", "s", month(1), True, 1.0), ("b", "s", month(1), False, 1.0), ("c", "t", month(2), False, 1.0), ("x", "s", month(1), False, None)]
    second = [("d", "s", month(1), True, 1.0), ("c", "u", month(3), True, 1.0), ("x", "s", month(1), False, 3.0)]
    twice, once = str(tmp_path / "twice"), str(tmp_path / "once")
    jobs.load(spark, shipments(spark, first), twice, FIRST)
    assert [r.order_id for r in jobs.rejected_table(spark, twice).read().collect()] == ["x"]
    jobs.load(spark, shipments(spark, second), twice, SECOND)
    jobs.load(spark, shipments(spark, first[:2] + second), once, FIRST)
    for table in (jobs.kpi_daily_table, jobs.seller_stats_table, jobs.rejected_table):
        rows = [sorted(map(str, table(spark, root).read().drop("updated_at").collect())) for root in (twice, once)]
        assert rows[0] == rows[1]
    assert {r.seller_id: r.total_orders for r in jobs.seller_stats_table(spark, twice).read().collect()} == {"s": 4, "u": 1}
    assert jobs.rejected_table(spark, twice).read().count() == 0


def test_retrain_promotes_only_a_better_model(spark, tmp_path):
    root = str(tmp_path)
    n = F.col("id")
    rows = spark.range(400).select(
        F.format_string("o%04d", n).alias("order_id"),
        F.lit("c").alias("customer_id"),
        F.concat(F.lit("s"), n % 10).alias("seller_id"),
        F.lit("toys").alias("category_name"),
        F.lit("SP").alias("seller_state"),
        (F.lit(dt.datetime(2023, 1, 1)) + F.make_dt_interval(hours=n.cast("int"))).cast("timestamp_ntz").alias("purchase_timestamp"),
        (n % 4 == 0).alias("is_late"),
        (F.when(n % 4 == 0, 900) .otherwise(100) + n % 50).cast("double").alias("distance_km"),
        F.lit(0.2).alias("seller_historical_delay_rate"),
        F.lit(1).alias("day_of_week"),
        F.lit(1).alias("month"),
        F.lit(10.0).alias("price"),
        F.lit(1.0).alias("freight_value"),
    )
    jobs.shipments_table(spark, root).merge(rows, FIRST)
    first = jobs.run_retrain(spark, root, SECOND, numTrees=3, maxDepth=3, featureSubsetStrategy="all")
    assert first["retrained"] and first["promoted"] and first["new_f1"] == 1.0
    second = jobs.run_retrain(spark, root, "2024-03-01 00:00:00", force=True, numTrees=3, maxDepth=3, featureSubsetStrategy="all")
    assert (second["old_f1"], second["promoted"]) == (1.0, False)
    assert spark.read.parquet(f"{root}/models/runs").count() == 2
    open_rows = rows.withColumn("delivered_timestamp", F.lit(None).cast("timestamp_ntz")).withColumn(
        "estimated_delivery", F.col("purchase_timestamp")
    ).withColumn("customer_state", F.lit("MG"))
    stats = jobs.run_alerts(spark, root, open_rows, "2023-01-01 00:00:00")
    assert stats["total_flagged"] == 100
    uri = spark.read.parquet(f"{root}/models/versions").first().storage_path
    lines = spark.read.text(f"{uri}/importances").collect()
    assert {json.loads(r.value)["feature"] for r in lines} >= {"distance_km", "price"}
