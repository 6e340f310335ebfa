from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from haulmark.schemas import SOURCE_FILES  # noqa: E402
from haulmark.session import build_session  # noqa: E402
from haulmark.sources import csv_files  # noqa: E402

WEEK_1 = dt.datetime(2024, 1, 1, 9)
WEEK_2 = dt.datetime(2024, 1, 8, 9)

KPI_DDL = (
    "order_id string, seller_id string, seller_state string, customer_state string, distance_km double,"
    " delay_days double, is_late boolean, freight_value double, category_name string,"
    " purchase_timestamp timestamp_ntz, delivered_timestamp timestamp_ntz"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "haulmark-tests",
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def kpi_rows(n, seller, state, category, week, late, start=0):
    return [
        (
            f"{seller}-{category}-{start + i:04d}", seller, state, "MG", 500.0, 5.0 if late else -2.0, late, 10.0,
            category, week, week + dt.timedelta(days=3),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="session")
def sample(spark):
    """110 delivered shipments of two sellers in two weeks, 24 of them late."""
    rows = (
        kpi_rows(50, "seller_A", "SP", "electronics", WEEK_1, False)
        + kpi_rows(10, "seller_A", "SP", "electronics", WEEK_1, True, 50)
        + kpi_rows(10, "seller_B", "RJ", "furniture", WEEK_2, True)
        + kpi_rows(30, "seller_B", "RJ", "furniture", WEEK_2, False, 10)
        + kpi_rows(4, "seller_A", "SP", "electronics", WEEK_2, True, 60)
        + kpi_rows(6, "seller_A", "SP", "electronics", WEEK_2, False, 64)
    )
    return spark.createDataFrame(rows, KPI_DDL).cache()


@pytest.fixture(scope="session")
def sample_all(sample, spark):
    from pyspark.sql import functions as F

    cancelled = spark.range(10).select(F.format_string("cancelled-%d", "id").alias("order_id"))
    return (
        sample.withColumn("order_status", F.lit("delivered"))
        .unionByName(cancelled.withColumn("order_status", F.lit("cancelled")), allowMissingColumns=True)
        .cache()
    )


CSV = {
    "orders": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2018-01-02 10:00:00,,,2018-01-12 12:00:00,2018-01-10 00:00:00
o2,c2,delivered,2018-01-03 10:00:00,,,not a date,2018-01-10 00:00:00
o1,c9,canceled,2018-01-05 10:00:00,,,,2018-01-10 00:00:00
,c3,delivered,2018-01-03 10:00:00,,,2018-01-04 10:00:00,2018-01-10 00:00:00
o3,c1,shipped,2018-01-15 23:30:00,,,,2018-02-01 00:00:00
o4,c2,delivered,2018-01-16 08:00:00,,,2018-01-20 00:00:00,2018-01-21 12:00:00
""",
    "order_items": """order_id,order_item_id,product_id,seller_id,price,freight_value
o1,2,p2,s2,20.00,4.00
o1,1,,s1,10.50,
o2,1,p1,s1,5.00,1.00
o3,1,p3,s1,7.00,2.00
""",
    "products": "product_id,product_category_name\np1,beleza\np2,moveis\np3,\n",
    "category_translation": "product_category_name,product_category_name_english\nbeleza,health_beauty\n",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01001,sao paulo,SP\ns2,20000,rio,RJ\n",
    "customers": "customer_id,customer_zip_code_prefix,customer_city,customer_state\nc1,20000,rio,RJ\nc2,99999,x,MG\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
    "01001,-23.55,-46.63,sp,SP\n01001,-23.50,-46.60,sp,SP\n20000,-22.90,-43.20,rio,RJ\n",
    "order_payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    "o1,1,card,1,10.00\no1,2,voucher,1,4.50\no2,1,card,1,\n",
    "order_reviews": 'review_id,order_id,review_score,review_comment_message\nr1,o1,3,"two\nlines, ""quoted"""\nr2,o1,5,\n',
}


@pytest.fixture(scope="session")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for table, stem in SOURCE_FILES.items():
        (folder / f"{stem}.csv").write_text(CSV[table])
    return str(folder)


@pytest.fixture(scope="session")
def sources(spark, raw):
    return csv_files.read_sources(spark, raw)
