import datetime as dt

import pytest
from pyspark.sql import functions as F

from haulmark.functions import numbers
from haulmark.operators import audit, cleaning
from haulmark.schemas import SOURCE_FILES
from haulmark.sources import csv_files
from tests.conftest import CSV

def test_missing_folder_and_file(spark, raw, tmp_path):
    with pytest.raises(FileNotFoundError, match="not found"):
        csv_files.check_complete(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError, match="olist_orders_dataset.csv"):
        csv_files.check_complete(spark, str(tmp_path))


def test_types_are_pinned(sources):
    assert dict(sources["sellers"].dtypes)["seller_zip_code_prefix"] == "string"
    assert sources["sellers"].where("seller_id = 's1'").first().seller_zip_code_prefix == "01001"
    assert dict(sources["order_items"].dtypes)["order_item_id"] == "bigint"
    assert sources["order_reviews"].count() == 2


def test_value_that_does_not_fit_is_loud_or_kept(spark, raw, tmp_path):
    stem = SOURCE_FILES["order_items"]
    (tmp_path / f"{stem}.csv").write_text(CSV["order_items"] + "o9,one,p1,s1,1,1\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_files.read_table(spark, str(tmp_path), "order_items").collect()
    kept = csv_files.read_table(spark, str(tmp_path), "order_items", mode="PERMISSIVE").cache()
    assert kept.where(F.col("_corrupt_record").isNotNull()).first()._corrupt_record == "o9,one,p1,s1,1,1"


def test_first_copy_in_file_order_wins(sources):
    orders = {r.order_id: r for r in cleaning.unique_orders(sources["orders"], csv_files.ORDINAL).collect()}
    assert set(orders) == {"o1", "o2", "o3", "o4"}
    assert (orders["o1"].customer_id, orders["o1"].order_status) == ("c1", "delivered")
    assert orders["o2"].delivered_timestamp is None


def test_file_order_survives_splitting(spark, tmp_path):
    stem = SOURCE_FILES["orders"]
    lines = [f"o{i % 500},c{i},delivered,2018-01-01,,,,2018-01-02" for i in range(5000)]
    (tmp_path / f"{stem}.csv").write_text("\n".join([CSV["orders"].splitlines()[0], *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        orders = csv_files.read_table(spark, str(tmp_path), "orders", ordinal=True)
        assert orders.rdd.getNumPartitions() > 5
        kept = cleaning.keep_first(orders, "order_id", csv_files.ORDINAL)
        assert {(r.order_id, r.customer_id) for r in kept.collect()} == {(f"o{i}", f"c{i}") for i in range(500)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_first_item_takes_the_first_value_of_each_column(sources):
    items = {r.order_id: r for r in cleaning.first_items(sources["order_items"]).collect()}
    # Item 1 has no product and no freight: those two come from item 2.
    assert tuple(items["o1"])[1:] == ("p2", "s1", 10.5, 4.0)


def test_clean_shipments(sources):
    rows = {r.order_id: r for r in cleaning.clean_shipments(sources, csv_files.ORDINAL).collect()}
    assert set(rows) == {"o1", "o2", "o4"}
    first, second, bare = rows["o1"], rows["o2"], rows["o4"]
    assert first.delay_days == pytest.approx(2.5) and first.is_late
    assert (float(first.payment_value), first.review_score, first.category_name) == (14.5, 5, None)
    assert (second.delay_days, second.is_late, second.category_name) == (None, False, "health_beauty")
    assert float(second.payment_value) == 0.0  # paid, but without an amount
    assert (bare.seller_id, float(bare.price), bare.payment_value, bare.delay_days) == (None, 0.0, None, -1.5)


def test_audits(sources):
    counts = audit.order_audit(sources["orders"], csv_files.ORDINAL).first()
    assert (counts.raw_rows, counts.null_key_rows, counts.duplicate_rows, counts.orders) == (6, 1, 1, 4)
    lost = audit.coercion_audit(sources["orders"], ["order_delivered_customer_date", "order_approved_at"])
    assert {r.column_name: r.coerced_to_null for r in lost.collect()} == {
        "order_delivered_customer_date": 1, "order_approved_at": 0,
    }
    shipments = cleaning.clean_shipments(sources, csv_files.ORDINAL)
    assert [r.reject_reason for r in audit.rejected(shipments).collect()] == ["seller_id"]
    assert audit.storable(shipments).count() == 2


def test_audit_follows_the_copy_that_is_kept(spark):
    rows = [("a", "shipped", 1), ("a", "delivered", 2), ("b", "delivered", 1), ("b", "canceled", 2)]
    raw = spark.createDataFrame(rows, "order_id string, order_status string, n int")
    counts = audit.order_audit(raw, ["n"]).first()
    assert (counts.orders, counts.duplicate_rows, counts.delivered_orders) == (2, 2, 1)


def test_large_amounts_stay_and_those_that_do_not_fit_are_rejected(spark):
    ddl = "order_id string, price string"
    amounts = [("big", "250000000.25"), ("none", None), ("text", "abc"), ("nan", "NaN"), ("over", "1" * 20)]
    priced = spark.createDataFrame(amounts, ddl).withColumn("price", numbers.money(F.col("price")))
    assert {r.order_id: r.price and float(r.price) for r in priced.collect()} == {
        "big": 250000000.25, "none": 0.0, "text": 0.0, "nan": 0.0, "over": None,
    }
    given = {"customer_id": F.lit("c"), "seller_id": F.lit("s"), "freight_value": F.lit(1.0), "is_late": F.lit(False)}
    shipments = priced.withColumns(given)
    assert {r.order_id for r in audit.storable(shipments).collect()} == {"big", "none", "text", "nan"}
    assert [(r.order_id, r.reject_reason) for r in audit.rejected(shipments).collect()] == [("over", "price")]


def test_offsets_convert_to_utc(spark):
    df = spark.createDataFrame([("2018-01-01T22:00:00-03:00",)], "order_purchase_timestamp string")
    assert cleaning.parse_timestamps(df).first()[0] == dt.datetime(2018, 1, 2, 1)
