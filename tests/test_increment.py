"""Loads of added files against a load of everything."""

import random

import pytest

from haulmark.plans import jobs
from haulmark.schemas import SOURCE_FILES
from haulmark.sources import csv_files
from tests.conftest import CSV
from tests.test_ledger import plain

AS_OF = "2024-01-01 00:00:00"
HEADS = {table: text.split("\n")[0] for table, text in CSV.items()}


def put(folder, part, tables):
    for table, lines in tables.items():
        where = folder / f"{SOURCE_FILES[table]}.csv"
        where.mkdir(parents=True, exist_ok=True)
        (where / f"part-{part}.csv").write_text("\n".join([HEADS[table], *lines]) + "\n")


LOOKUPS = {t: CSV[t].strip().split("\n")[1:] for t in ("products", "category_translation", "sellers", "customers", "geolocation")}


def random_part(rng, low, high):
    orders, items, payments, reviews = [], [], [], []
    for _ in range(25):
        n = rng.randint(low, high)
        day, status = rng.randint(1, 28), rng.choice(["delivered", "delivered", "shipped", "canceled"])
        orders.append(f"o{n},c{rng.randint(1, 3)},{status},2018-0{rng.randint(1, 4)}-{day:02d} 10:00:00,,,2018-05-{day:02d} 12:00:00,2018-05-10 00:00:00")
        for _ in range(rng.randint(0, 3)):
            # Values follow from the number, so that which of two equal items comes first does not matter.
            k = rng.randint(1, 4)
            items.append(f"o{rng.randint(low, high)},{k},{['', 'p1', 'p2', 'p3', 'p1'][k]},{'s1' if k % 2 else 's2'},{k}.50,{['1.00', '', '2.25', '3.00'][k % 4]}")
        payments.append(f"o{rng.randint(low, high)},1,card,1,{rng.choice(['10.10', '', '0.07'])}")
        reviews.append(f"r,o{rng.randint(low, high)},{rng.randint(1, 5)},")
    return {"orders": orders, "order_items": items, "order_payments": payments, "order_reviews": reviews}


def stored(spark, root):
    for table in (jobs.shipments_table, jobs.all_orders_table, jobs.rejected_table, jobs.open_shipments_table, jobs.kpi_daily_table):
        rows = table(spark, root).read().drop("created_at", "updated_at", "seller_historical_delay_rate")
        yield plain(rows.collect())


def test_increments_equal_a_whole_load(spark, tmp_path):
    rng, raw, root = random.Random(7), tmp_path / "raw", str(tmp_path / "tables")
    put(raw, 0, LOOKUPS | random_part(rng, 0, 40))
    jobs.run_increment(spark, str(raw), root, AS_OF)
    assert jobs.run_increment(spark, str(raw), root, AS_OF)["shipments"] == 0
    assert jobs.order_states_table(spark, root).version() == 1
    # Later parts add orders, repeat old ones and bring late items, payments and reviews.
    put(raw, 1, random_part(rng, 20, 60))
    opened = []
    whole = csv_files.read_table

    def watched(*args, **kw):
        df = whole(*args, **kw)
        opened.extend(f for f in df.inputFiles() if "orders" in f or "order_" in f)
        return df

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(csv_files, "read_table", watched)
        jobs.run_increment(spark, str(raw), root, AS_OF, verify=True)
    assert len(opened) == 4 and all(f.endswith("part-1.csv") for f in opened)
    jobs.run_etl(spark, csv_files.read_sources(spark, str(raw)), csv_files.ORDINAL, str(tmp_path / "whole"), AS_OF)
    assert list(stored(spark, root)) == list(stored(spark, str(tmp_path / "whole")))
    files = jobs.order_states_table(spark, root).notes()["files"]
    assert {len(v) for v in files.values()} == {2}


def test_a_part_of_some_tables(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "tables")
    put(raw, 0, LOOKUPS | {
        "orders": ["o1,c1,delivered,2018-01-02 10:00:00,,,2018-01-12 12:00:00,2018-01-10 00:00:00"],
        "order_items": ["o1,2,p1,s1,5.00,1.00", "late,1,p1,s1,9.00,1.00"], "order_payments": ["o1,1,card,1,"], "order_reviews": [],
    })
    jobs.run_increment(spark, str(raw), root, AS_OF)
    put(raw, 1, {"order_reviews": ["r,o1,4,"], "orders": ["late,c2,delivered,2018-02-02 10:00:00,,,2018-02-12 12:00:00,2018-02-20 00:00:00"]})
    jobs.run_increment(spark, str(raw), root, AS_OF)
    rows = {r.order_id: r for r in jobs.shipments_table(spark, root).read().collect()}
    assert (rows["o1"].review_score, float(rows["o1"].payment_value), float(rows["late"].price)) == (4, 0.0, 9.0)
    assert rows["late"].review_score is None and rows["late"].payment_value is None


def test_changed_files_are_refused(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "tables")
    put(raw, 0, LOOKUPS | random_part(random.Random(1), 0, 9))
    jobs.run_increment(spark, str(raw), root, AS_OF)
    reviews = raw / f"{SOURCE_FILES['order_reviews']}.csv" / "part-0.csv"
    text = reviews.read_text()
    reviews.write_text(text.replace("r,o", "q,o", 1))
    with pytest.raises(ValueError, match="other content"):
        jobs.run_increment(spark, str(raw), root, AS_OF, verify=True)
    reviews.write_text(text + "r,o1,5,\n")
    with pytest.raises(ValueError, match="has changed"):
        jobs.run_increment(spark, str(raw), root, AS_OF)
