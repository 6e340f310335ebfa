"""Loads kept up by retraction against rebuilding from all rows; what a merge opens; how heavy keys are split."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from haulmark.operators import aggregates, ledger, lookups
from haulmark.plans import jobs
from haulmark.sources import stored

AS_OF = "2024-01-01 00:00:00"
DDL = (
    "order_id string, customer_id string, seller_id string, seller_state string, category_name string,"
    " purchase_timestamp timestamp_ntz, delay_days double, is_late boolean, price double, freight_value double"
)


def random_shipment(rng, order):
    seller = rng.choice(["hot"] * 5 + [f"s{i}" for i in range(9)])
    delay = rng.choice([None, -3.0, 0.0, rng.randint(1, 10**11) / 86_400e6])
    when = None if rng.random() < 0.05 else dt.datetime(2017, rng.randint(1, 5), rng.randint(1, 28), rng.randint(0, 23))
    state, category = rng.choice(["SP", "RJ", None]), rng.choice(["toys", "books", None])
    amounts = rng.choice([None, 1.1, 2.25, 99.99]), rng.choice([0.1, 0.2, 7.77])
    return (f"o{order}", "c", seller, state, category, when, delay, bool(delay and delay > 0), *amounts)


def plain(rows):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


def test_loads_with_replaced_rows_equal_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "MAX_PARTS", 2)  # so that parts are written as one on the way
    rng = random.Random(3)
    loaded, once = {}, str(tmp_path / "once")
    root = str(tmp_path / "loads")
    for _ in range(3):
        batch = {r[0]: r for r in (random_shipment(rng, rng.randint(0, 120)) for _ in range(60))}
        jobs.load(spark, spark.createDataFrame(list(batch.values()), DDL), root, AS_OF)
        for order, row in batch.items():
            if row[8] is not None or order not in loaded:  # a row without a price is kept aside, the stored one stays
                loaded[order] = row
    final = spark.createDataFrame(list(loaded.values()), DDL)
    jobs.load(spark, final, once, AS_OF)
    table = jobs.shipments_table(spark, root)
    rows = table.read()
    assert rows.count() == jobs.shipments_table(spark, once).read().count() == sum(r[8] is not None for r in loaded.values())
    for name, made in (("kpi_daily", aggregates.kpi_daily(rows)), ("seller_stats", aggregates.seller_stats(rows))):
        kept = [getattr(jobs, f"{name}_table")(spark, where).read().drop("updated_at") for where in (root, once)]
        assert plain(kept[0].collect()) == plain(kept[1].collect())
        assert plain(kept[0].collect()) == plain(made.select(*kept[0].columns).collect())
    for grain, dims in ledger.SHIPMENT_LEDGER.grains.items():
        direct = ledger.SHIPMENT_LEDGER.signed(rows).where(F.col("grain") == grain)
        columns = [*dims, *ledger.SHIPMENT_LEDGER.measures]
        want = direct.na.fill(0).select(*columns).collect()
        assert sorted(map(str, table.sums(grain).na.fill(0).select(*columns).collect())) == sorted(map(str, want))


def test_same_load_again_changes_no_sum(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([random_shipment(rng, i) for i in range(30)], DDL).where("price is not null")
    table = jobs.shipments_table(spark, str(tmp_path))
    table.merge(rows, AS_OF)
    assert table.touched("day").count() > 0
    table.merge(rows, AS_OF)
    assert table.touched("day").count() == 0


def test_a_batch_opens_its_buckets_and_months_only(spark, tmp_path, monkeypatch):
    table = jobs.shipments_table(spark, str(tmp_path))
    rows = [(f"o{i}", "c", "s", "SP", "toys", dt.datetime(2017, 1 + i % 6, 5), 1.0, True, 1.0, 1.0) for i in range(60)]
    table.merge(spark.createDataFrame(rows, DDL), AS_OF)
    opened = []
    whole = stored.StoredTable._open
    monkeypatch.setattr(stored.StoredTable, "_open", lambda self, folders, ddl: (opened.extend(folders), whole(self, folders, ddl))[1])
    batch = spark.createDataFrame([(*rows[6][:5], dt.datetime(2017, 2, 9), *rows[6][6:]), ("new", *rows[1][1:])], DDL)
    assert table.rows_of(batch).count() == 1
    table.merge(batch, AS_OF)
    buckets = {row.b for row in batch.select(table._bucket(8).alias("b")).collect()}
    assert {f.rsplit("bucket=")[1] for f in opened if "/keys/" in f} == set(map(str, buckets)) and len(buckets) < 8
    assert {f.rsplit("part=")[1] for f in opened if "/data/" in f} == {"2017-01", "2017-02"}  # left its month, moved into one
    stays = {r.order_id: r.purchase_timestamp.month for r in table.read().collect()}
    assert len(stays) == 61 and stays["o6"] == 2


def test_replacing_takes_rows_out_without_reading_all(spark, tmp_path):
    table = jobs.open_shipments_table(spark, str(tmp_path))
    rows = [(f"o{i}", "s", dt.datetime(2017, 1 + i, 5)) for i in range(4)]
    ddl = "order_id string, seller_id string, purchase_timestamp timestamp_ntz"
    table.merge(spark.createDataFrame(rows, ddl), AS_OF)
    before = table._parts(1)
    gone = spark.createDataFrame([("o1",), ("unknown",)], "order_id string")
    table.merge(spark.createDataFrame(rows[:1], ddl), AS_OF, replacing=gone)
    assert sorted(r.order_id for r in table.read().collect()) == ["o0", "o2", "o3"]
    assert table._parts(2)["2017-03"] == before["2017-03"] and "2017-02" not in table._parts(2)
    assert table.rows_of(gone).count() == 0


def test_table_without_companions_gets_them(spark, tmp_path):
    rows = spark.createDataFrame([random_shipment(random.Random(i), i) for i in range(30)], DDL).where("price is not null")
    bare = stored.StoredTable(spark, f"{tmp_path}/shipments", jobs.SHIPMENTS, "order_id", "purchase_timestamp", ("created_at",))
    bare.merge(rows, AS_OF)
    old = bare._snapshot()
    old.buckets, old.keys = 0, {}
    bare._publish(2, old)
    table = jobs.shipments_table(spark, str(tmp_path))
    table.merge(rows.limit(3), AS_OF)
    assert table.read().count() == rows.count()
    assert plain(ledger.kpi_daily(table.sums("day")).collect()) == plain(aggregates.kpi_daily(table.read()).collect())


@pytest.mark.parametrize("stored_rows", [True, False])
def test_only_heavy_keys_are_split(spark, tmp_path, stored_rows):
    n, sellers = 30_000, 100
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % sellers)).alias("seller_id"),
    )
    if stored_rows:
        rows.write.parquet(f"{tmp_path}/rows")
        rows = spark.read.parquet(f"{tmp_path}/rows")
    weights = lookups.key_weights(rows, "seller_id")
    heavy = lookups.heavy_keys(weights, "seller_id", 8)
    assert [(r.seller_id, r._shares) for r in heavy.collect()] == [("hot", 3)]
    lookup = weights.select("seller_id", (F.col("n") * 2).alias("twice"))
    repeated = lookups.salted(lookup, heavy, "seller_id")
    assert repeated.count() == lookup.count() + 2 <= 2 * lookup.count()
    joined = lookups.lookup_derived(rows, lookup, "seller_id", "order_id", weights)
    want = rows.join(lookup, "seller_id", "left")
    assert joined.columns == want.columns
    assert sorted(map(str, joined.collect())) == sorted(map(str, want.collect()))


def test_routing_takes_the_coarsest_grain():
    routes = ledger.SHIPMENT_LEDGER.coarsest
    assert (routes(), routes("date"), routes("week_start"), routes("category_name")) == ("day", "day", "day", "category")
    assert (routes("seller_id"), routes("week_start", "seller_id")) == ("seller", "week_seller_category")
    with pytest.raises(ValueError, match="no grain"):
        routes("date", "seller_id")
