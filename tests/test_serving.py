"""Stored answers against the direct ones, what they open, and order-bucketed inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from haulmark.operators import browse, kpi, pages, reporting, rollup
from haulmark.plans import jobs, serving
from haulmark.plans.shipments import enriched_shipments
from haulmark.sources import bucketed, star
from tests.test_ledger import AS_OF, DDL, plain, random_shipment

WEEK = "2017-02-15"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """Three hundred shipments stored in two loads, the second with replaced rows."""
    folder, rng = str(tmp_path_factory.mktemp("served")), random.Random(9)
    for low, high in ((0, 200), (150, 300)):
        rows = spark.createDataFrame([random_shipment(rng, i) for i in range(low, high)], DDL).na.fill(5.0, ["price"])
        jobs.shipments_table(spark, folder).merge(rows, AS_OF)
        statuses = rows.withColumn("order_status", F.when(F.hash("order_id") % 3 == 0, "shipped").otherwise("delivered"))
        jobs.all_orders_table(spark, folder).merge(statuses, AS_OF)
    return folder


def test_stored_figures_equal_direct_ones_and_read_no_rows(spark, root):
    shipments, orders = jobs.shipments_table(spark, root).read(), jobs.all_orders_table(spark, root).read()
    sums = jobs.shipments_table(spark, root).sums
    pairs = [
        (serving.kpi_summary(spark, root), kpi.kpi_summary(shipments, orders)),
        (serving.seller_scorecard(spark, root), kpi.ranked_scorecard(shipments)),
        (serving.seller_scorecard(spark, root, "avg_cost", "asc", 3), kpi.ranked_scorecard(shipments, "avg_cost", "asc", 3)),
        (serving.weekly_otif_trend(spark, root), kpi.weekly_otif_trend(shipments)),
        (serving.delay_by_category(spark, root), kpi.delay_by_category(shipments)),
        (rollup.week_metrics(sums, WEEK), reporting.week_metrics(shipments, WEEK)),
        (rollup.week_otif_trend(sums, WEEK), reporting.week_otif_trend(shipments, WEEK, bounded=True)),
        (rollup.critical_sellers(sums, WEEK, None), reporting.critical_sellers(shipments, WEEK, None)),
    ]
    for served, direct in pairs:
        assert served.columns == direct.columns
        assert plain(served.collect()) == plain(direct.collect())
        files = served.inputFiles()
        assert files and all("/ledger/" in f for f in files)


@pytest.mark.parametrize("fine", [100_000, 3])
def test_ranked_pages_equal_offset_pages(spark, root, monkeypatch, fine):
    monkeypatch.setattr(pages, "FINE_ROWS", fine)
    table = jobs.shipments_table(spark, root)
    for page, size in ((1, 7), (2, 7), (3, 40), (9, 33), (10, 33), (99, 10)):
        want = browse.details(browse.page_of(table.read(), page, size)).collect()
        assert serving.shipments_page(spark, root, page, size).collect() == want
        assert browse.details(pages.ranked_page(table.read(), page, size)).collect() == want


def test_a_deep_page_opens_its_months_only(spark, root):
    files = serving.shipments_page(spark, root, 12, 20).inputFiles()
    months = {re.search(r"part=([^/]+)", f)[1] for f in files}
    assert 1 <= len(months) <= 2 and "none" not in months
    assert pages.locate([(None, 3), (1, 10), (2, 5)], 4, 10) == ([(1, 10), (2, 5)], 1)
    assert pages.locate([(None, 3), (1, 10)], 20, 10) == ([], 0)


def test_a_time_range_opens_its_months_only(spark, root):
    found = serving.shipments_between(spark, root, "2017-02-10", "2017-03-02", status="late")
    rows = jobs.shipments_table(spark, root).read()
    want = browse.details(rows.where("is_late and purchase_timestamp >= '2017-02-10' and purchase_timestamp < '2017-03-02'"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    assert {re.search(r"part=([^/]+)", f)[1] for f in found.inputFiles()} <= {"2017-02", "2017-03"}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_bucketed_sources_need_no_order_shuffle(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = star.StarSources(spark, "/root/testdata/sf0.001")
        staged = bucketed.BucketedSources(spark, raw)
        from haulmark.operators.cleaning import order_facts

        facts = order_facts(staged, star.ORDINAL, delivered=False)
        plan = final_plan(facts)
        assert "Exchange" not in plan and plan.count("Scan parquet") == 4
        assert "Exchange" in final_plan(order_facts(raw, star.ORDINAL, delivered=False))
        got, want = (enriched_shipments(s, star.ORDINAL, delivered=False) for s in (staged, raw))
        plan = final_plan(got)
        assert not re.search(r"hashpartitioning\(order_id", plan)
        assert got.columns == want.columns and plain(got.collect()) == plain(want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_an_input_with_a_heavy_order_is_not_bucketed(spark, monkeypatch):
    monkeypatch.setattr(bucketed, "HEAVY_ROWS", 20)
    items = spark.range(100).select(
        F.when(F.col("id") < 60, "hot").when(F.col("id") == 99, None).otherwise(F.col("id").cast("string")).alias("order_id"), F.lit("p").alias("product_id")
    )
    reviews = items.where("order_id <> 'hot' or order_id is null")
    staged = bucketed.BucketedSources(spark, {"order_items": items, "order_reviews": reviews, "products": items})
    assert staged["order_items"] is items and staged["products"] is items
    assert staged["order_reviews"].count() == 39 and len(staged["order_reviews"].inputFiles()) <= 8


def test_bucketed_files_serve_another_session(spark, tmp_path):
    orders = star.StarSources(spark, "/root/testdata/sf0.001")["orders"]
    bucketed.write_bucketed(orders, f"{tmp_path}/orders", 5)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in orders.schema.fields)
    again = bucketed.read_bucketed(spark.newSession(), f"{tmp_path}/orders", ddl, 5)
    assert sorted(map(str, again.collect())) == sorted(map(str, orders.collect()))


@pytest.mark.parametrize("text", ["o12", "O1", "s3", "hot", "HO", "o1_3", "o%99", "t%", "o29", "zzz", "ö12", "", "o\\_1"])
def test_search_equals_the_scan(spark, root, text):
    want = browse.details(browse.filter_shipments(jobs.shipments_table(spark, root).read(), search=text))
    assert plain(serving.shipments_search(spark, root, text).collect()) == plain(want.collect())


def test_search_opens_candidate_files_only(spark, root):
    table = jobs.shipments_table(spark, root)
    found = table.search("o123")
    assert [r.order_id for r in found.collect()] == ["o123"]
    assert len(found.inputFiles()) == 1 < len(table.read().inputFiles())
    assert table.search("o12345").inputFiles() == []


def test_search_after_many_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("haulmark.sources.stored.MAX_PARTS", 2)
    rng, table = random.Random(2), jobs.shipments_table(spark, str(tmp_path))
    for _ in range(3):
        rows = spark.createDataFrame([random_shipment(rng, i) for i in range(rng.randint(10, 40))], DDL).na.fill(5.0, ["price"])
        table.merge(rows, AS_OF)
    assert len(table._snapshot().grams) <= 2
    for text in ("o1%", "hot", "o12"):
        want = table.read().where(browse.id_contains(text))
        assert plain(table.search(text).collect()) == plain(want.collect())


def test_changes_between_versions(spark, tmp_path):
    table, rng = jobs.open_shipments_table(spark, str(tmp_path)), random.Random(6)
    first = [random_shipment(rng, i) for i in range(40)]
    table.merge(spark.createDataFrame(first, DDL), AS_OF)
    moved = [(*first[3][:4], "other", *first[3][5:]), first[4], (*first[5][:5], None, *first[5][6:])]
    gone = spark.createDataFrame([("o7",)], "order_id string")
    table.merge(spark.createDataFrame([*moved, random_shipment(rng, 99)], DDL), AS_OF, replacing=gone)
    changed, lost = table.changes(1)
    assert sorted(r.order_id for r in changed.collect()) == sorted({"o3", "o99"} | ({"o5"} if first[5][5] else set()))
    assert [r.order_id for r in lost.collect()] == ["o7"]
    assert table.changes(2)[0].count() == table.changes(2)[1].count() == 0


def test_alerts_score_only_what_changed(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path), []

    class Model:
        threshold = 0.5

        def __call__(self, rows):
            seen.append(rows.count())
            return rows.withColumn("delay_probability", F.pmod(F.xxhash64("order_id", "price"), F.lit(100)) / 100)

    model = Model()
    monkeypatch.setattr(jobs.ForestModel, "load", lambda spark, path: model)
    monkeypatch.setattr(jobs, "active_version", lambda spark, root: jobs.Row(storage_path="first"))
    rng = random.Random(4)

    def orders(ids):
        rows = spark.createDataFrame([random_shipment(rng, i) for i in ids], DDL)
        return rows.withColumns({"order_status": F.lit("shipped"), "estimated_delivery": F.lit("2024-02-01").cast("timestamp_ntz")})

    def full():
        rows = jobs.open_shipments_table(spark, root).read()
        return jobs.run_alerts(spark, root, rows, AS_OF)

    table = jobs.open_shipments_table(spark, root)
    table.merge(orders(range(60)), AS_OF)
    stats = jobs.run_alerts(spark, root, None, AS_OF)
    assert seen == [60] and stats["total_flagged"] > 0
    assert jobs.run_alerts(spark, root, None, AS_OF) == stats and seen == [60]  # nothing changed, nothing is scored
    assert full() == stats
    table.merge(orders(range(50, 65)), AS_OF, replacing=spark.createDataFrame([("o1",), ("o2",)], "order_id string"))
    del seen[:]
    assert jobs.run_alerts(spark, root, None, AS_OF) == full() and seen == [15, 63]
    monkeypatch.setattr(jobs, "active_version", lambda spark, root: jobs.Row(storage_path="second"))
    del seen[:]
    jobs.run_alerts(spark, root, None, AS_OF)
    assert seen == [63]
