"""The nine source tables derived from an order/line-item star schema in Parquet."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDINAL = ["customer_id", "order_purchase_timestamp"]


# --- Fixed values: column types of the star tables, so that no job runs to infer them. ----
STAR_TYPES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def read_star(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(STAR_TYPES[table]).parquet(f"{folder.rstrip('/')}/{table}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Promised 10 to 30 days after purchase by priority; delivered at the first ship date."""
    shipped = (
        read_star(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.min("l_shipdate").alias("first_ship"))
    )
    joined = read_star(spark, folder, "orders").join(shipped, "o_orderkey", "left")
    return joined.selectExpr(
        "cast(o_orderkey as string) as order_id",
        "cast(o_custkey as string) as customer_id",
        "case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'created' end as order_status",
        "o_orderdate as order_purchase_timestamp",
        "if(o_orderstatus = 'F', first_ship, null) as order_delivered_customer_date",
        "o_orderdate + make_dt_interval(10 + 5 * cast(substring(o_orderpriority, 1, 1) as int))"
        " as order_estimated_delivery_date",
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) as order_id",
        "cast(l_linenumber as bigint) as order_item_id",
        "cast(l_partkey as string) as product_id",
        "cast(l_suppkey as string) as seller_id",
        "l_extendedprice as price",
        "cast(l_quantity as int) * (1 + cast(round(l_tax * 100) as int)) * 0.25D as freight_value",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    part = read_star(spark, folder, "part")
    return part.selectExpr("cast(p_partkey as string) as product_id", "p_type as product_category_name")


def category_translation(spark: SparkSession, folder: str) -> DataFrame:
    """Every category but STANDARD, which stays without a name."""
    named = read_star(spark, folder, "part").where("p_type <> 'STANDARD'").select("p_type").distinct()
    return named.selectExpr(
        "p_type as product_category_name", "lower(p_type) as product_category_name_english"
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "supplier").selectExpr(
        "cast(s_suppkey as string) as seller_id",
        "cast(s_nationkey as string) as seller_zip_code_prefix",
        "s_name as seller_city",
        "concat('N', s_nationkey) as seller_state",
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "customer").selectExpr(
        "cast(c_custkey as string) as customer_id",
        "cast(c_nationkey as string) as customer_zip_code_prefix",
        "c_name as customer_city",
        "concat('N', c_nationkey) as customer_state",
    )


def geolocation(spark: SparkSession, folder: str) -> DataFrame:
    """Several points per nation; nation 24 has none."""
    return read_star(spark, folder, "customer").where("c_nationkey <> 24").selectExpr(
        "cast(c_nationkey as string) as geolocation_zip_code_prefix",
        "-33 + c_nationkey * 1.4D + (c_custkey % 10) * 0.01D as geolocation_lat",
        "-70 + c_nationkey * 1.3D + (c_custkey % 7) * 0.01D as geolocation_lng",
        "c_name as geolocation_city",
        "concat('N', c_nationkey) as geolocation_state",
    )


def order_payments(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "lineitem").selectExpr(
        "cast(l_orderkey as string) as order_id",
        "cast(l_linenumber as bigint) as payment_sequential",
        "'card' as payment_type",
        "1L as payment_installments",
        "l_extendedprice as payment_value",
    )


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) as review_id",
        "cast(l_orderkey as string) as order_id",
        "1 + cast(l_quantity as bigint) % 5 as review_score",
    )


TABLES = {
    "orders": orders,
    "order_items": order_items,
    "products": products,
    "sellers": sellers,
    "customers": customers,
    "geolocation": geolocation,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "category_translation": category_translation,
}


class StarSources(Mapping):
    """The nine sources by name, each planned when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = TABLES[name](self._spark, self._folder)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)
