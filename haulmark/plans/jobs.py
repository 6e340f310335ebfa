"""Jobs: load the tables, retrain the model, score open shipments, write the weekly report.

    PYTHONPATH=. spark-submit haulmark/plans/jobs.py etl --raw <folder> --tables <folder> --as-of <time>
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.times import Day, monday_of
from haulmark.operators import aggregates, audit, browse, cleaning, increment, ledger, registry, reporting, scoring
from haulmark.operators import evaluation as ev
from haulmark.operators.forest import ForestModel, Training, train_model
from haulmark.operators.ledger import ORDER_LEDGER, SHIPMENT_LEDGER
from haulmark.plans.shipments import enrich_facts
from haulmark.schemas import (
    ALL_ORDERS,
    DEFAULT_THRESHOLD,
    KPI_DAILY,
    OPEN_SHIPMENTS,
    ORDER_STATES,
    REJECTED,
    SCORES,
    SELLER_STATS,
    SHIPMENTS,
    SOURCE_FILES,
)
from haulmark.session import build_session, pin_utc
from haulmark.sources import csv_files
from haulmark.sources.stored import StoredTable
from haulmark.staging import stage, together


def shipments_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(
        spark, f"{root}/shipments", SHIPMENTS, "order_id", "purchase_timestamp", ("created_at",), cluster_by="seller_id",
        ledger=SHIPMENT_LEDGER, search_on=("order_id", "seller_id"),
    )


def kpi_daily_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/kpi_daily", KPI_DAILY, "date", stamps=("updated_at",))


def seller_stats_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/seller_stats", SELLER_STATS, "seller_id", stamps=("updated_at",))


def rejected_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/rejected", REJECTED, "order_id", "purchase_timestamp")


def all_orders_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/all_orders", ALL_ORDERS, "order_id", "purchase_timestamp", ledger=ORDER_LEDGER)


def open_shipments_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/open_shipments", OPEN_SHIPMENTS, "order_id", "purchase_timestamp")


def load(
    spark: SparkSession, shipments: DataFrame, root: str, as_of: str, unique: bool = False
) -> dict[str, int]:
    """Merge stored shipments; rows that break a constraint are kept aside. ``unique`` promises that keys are.

    Daily and seller figures are kept up by the table's ledger: the merge takes the replaced rows'
    sums out and adds those of the new rows, so no stored shipment outside the batch's keys is
    read and loads add up however the shipments were split into batches.
    """
    good = audit.storable(shipments)
    table = shipments_table(spark, root)
    table.merge(good, as_of, stored=True, unique=unique)

    def figures(target: StoredTable, grain: str, key: str, make: Callable[[DataFrame], DataFrame]) -> None:
        groups = stage(table.touched(grain).select(key).where(F.col(key).isNotNull()).distinct(), "touched")
        sums = table.sums(grain).join(groups, key, "left_semi")
        target.merge(make(sums), as_of, replacing=groups, unique=True)

    keys = shipments.select("order_id")
    *_, summary = together(
        lambda: figures(kpi_daily_table(spark, root), "day", "date", ledger.kpi_daily),
        lambda: figures(seller_stats_table(spark, root), "seller", "seller_id", ledger.seller_stats),
        lambda: rejected_table(spark, root).merge(audit.rejected(shipments), as_of, replacing=keys, unique=unique),
        lambda: aggregates.load_summary(good).first().asDict(),
    )
    return summary


def run_etl(
    spark: SparkSession, sources: cleaning.Sources, order_by: list[str], root: str, as_of: str
) -> dict[str, int]:
    """Clean, enrich and load.

    The facts of all statuses and the enriched result are each written once and then reused. The
    seller history is that of the stored shipments, known from their ledger, and of the batch;
    shipments stored earlier keep the rate they were loaded with. Open shipments are stored with
    their features.
    """
    pin_utc(spark)
    facts = stage(cleaning.order_facts(sources, order_by, delivered=False), "facts")
    return load_facts(spark, facts, sources, root, as_of)


def load_facts(spark: SparkSession, facts: DataFrame, sources: cleaning.Sources, root: str, as_of: str) -> dict[str, int]:
    """Enrich and load order facts of all statuses, which must be stored."""
    keys, table = facts.select("order_id"), shipments_table(spark, root)
    replaced = table.rows_of(keys) if table.version() else None
    rates = ledger.seller_rates(table.sums("seller"), replaced, facts)
    enriched = stage(enrich_facts(facts, sources, stage(rates, "rates")), "enriched")
    summary, *_ = together(
        lambda: load(spark, cleaning.delivered_only(enriched), root, as_of, unique=True),
        lambda: all_orders_table(spark, root).merge(facts, as_of, stored=True, unique=True),
        lambda: open_shipments_table(spark, root).merge(
            scoring.active_only(enriched), as_of, stored=True, replacing=keys, unique=True
        ),
    )
    return summary


def order_states_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/order_states", ORDER_STATES, "order_id", "purchase_timestamp")


def run_increment(spark: SparkSession, raw: str, root: str, as_of: str, verify: bool = False) -> dict[str, int]:
    """Load what was added to the raw folders since the last increment; equal to loading them whole.

    The manifest of read files (name, size, digest) is published with the states of their orders, after the load: an
    increment that fails is simply run again. Lookups are read whole; an order takes them as they are when it is
    loaded, and keeps the seller rate of that time. A file that was read must stay as it is: its size is checked, with
    ``verify`` its digest too. Keep-first goes by load, then by file.
    """
    pin_utc(spark)
    csv_files.check_complete(spark, raw)
    states = order_states_table(spark, root)
    known = states.notes().get("files", {})
    listed = {table: csv_files.parts_of(spark, raw, table) for table in increment.ORDER_KEYED}
    fresh = {table: increment.unread(table, files, known.get(table, {})) for table, files in listed.items()}
    if verify:
        increment.check_digests(spark, known)
    if not any(fresh.values()):
        return {"shipments": 0, "kpi_days": 0, "sellers": 0}
    parts = {
        table: csv_files.read_table(spark, raw, table, ordinal=table == "orders", files=files) for table, files in fresh.items() if files
    }
    added = stage(increment.states_of(parts, csv_files.ORDINAL, states.version() + 1), "order-states")
    merged = stage(increment.merged(states.rows_of(added), added), "order-states")
    lookups = {table: csv_files.read_table(spark, raw, table) for table in SOURCE_FILES if table not in increment.ORDER_KEYED}
    facts = stage(increment.facts_of(merged), "facts")
    summary = load_facts(spark, facts, lookups, root, as_of)
    made = csv_files.digests(spark, [file for files in fresh.values() for file in files])
    files = {t: known.get(t, {}) | {f: [listed[t][f], made[f]] for f in fresh[t]} for t in increment.ORDER_KEYED}
    states.merge(merged, as_of, stored=True, unique=True, notes={"files": files})
    return summary


def run_retrain(
    spark: SparkSession, root: str, as_of: str, threshold: float = DEFAULT_THRESHOLD, force: bool = False, **settings
) -> dict:
    """Train a challenger, compare F1 on the newest rows, promote it only if strictly better."""
    pin_utc(spark)
    shipments, models = shipments_table(spark, root).read(), f"{root}/models"
    versions = registry.read_versions(spark, models)
    nothing = {"retrained": False, "new_f1": 0.0, "old_f1": 0.0, "promoted": False}
    if shipments.isEmpty() or not (force or registry.retrain_decision(shipments, versions, as_of).first().retrain):
        return nothing
    older, holdout = ev.holdout_split(shipments)
    holdout = stage(holdout.withColumn("label", F.col("is_late").cast("int")), "holdout")

    training = train_model(older, threshold, **settings)
    active = registry.active_version(versions).first()
    old_f1 = 0.0
    if active is not None:
        old_f1 = _f1(ForestModel.load(spark, active.storage_path), holdout)
    new_f1 = _f1(training.model, holdout)

    run = save_run(spark, models, training, as_of)
    promoted = new_f1 > old_f1
    if promoted:
        registry.promote(spark, models, run, dt.datetime.fromisoformat(as_of))
    return {"retrained": True, "new_f1": new_f1, "old_f1": old_f1, "promoted": promoted}


def _f1(model: ForestModel, holdout: DataFrame) -> float:
    return ev.confusion(model(holdout), model.threshold).first().f1_late


def save_run(spark: SparkSession, models: str, training: Training, as_of: str) -> dict:
    """Write the model artefact and its experiment record."""
    run_id = uuid.uuid4().hex
    path = f"{models}/artifacts/{run_id}"
    training.model.save(path)
    run = {
        "run_id": run_id,
        "run_name": f"retrain-{as_of[:16].replace(' ', 'T')}",
        "logged_at": dt.datetime.fromisoformat(as_of),
        "params": training.params,
        "metrics": training.metrics,
        "importances": training.model.importances(),
        "artifact_uri": path,
    }
    registry.log_run(spark, models, run)
    return run


def active_version(spark: SparkSession, root: str) -> Row:
    active = registry.active_version(registry.read_versions(spark, f"{root}/models")).first()
    if active is None:
        raise RuntimeError("no active model; run the retrain job first")
    return active


def active_model(spark: SparkSession, root: str) -> ForestModel:
    return ForestModel.load(spark, active_version(spark, root).storage_path)


def scores_table(spark: SparkSession, root: str) -> StoredTable:
    return StoredTable(spark, f"{root}/scores", SCORES, "order_id", "purchase_timestamp")


def rescore(spark: SparkSession, root: str, model: Callable[[DataFrame], DataFrame], name: str, as_of: str) -> DataFrame:
    """Scores of the stored open shipments; only those that changed since the last run are scored.

    What changed is the difference of two snapshots of the table: the present one and the one that
    the scores were made from. Another model (``name``) scores everything anew.
    """
    table, scores = open_shipments_table(spark, root), scores_table(spark, root)
    known, version = scores.notes(), table.version()
    if known == {"model": name, "version": version}:
        return scores.read()
    if known.get("model") == name:
        changed, gone = table.changes(known["version"])
        gone = gone.unionByName(changed.select("order_id"))
    else:
        changed, gone = table.read(), scores.read().select("order_id")
    under_way = scoring.active_only(changed).where(F.col("delivered_timestamp").isNull())
    scored = stage(model(under_way).select(*[column for column, _, _ in SCORES]), "scored")
    notes = {"model": name, "version": version}
    scores.merge(scored, as_of, stored=True, unique=True, replacing=stage(gone, "gone"), notes=notes)
    return scores.read()


def run_alerts(spark: SparkSession, root: str, open_shipments: DataFrame | None, as_of: str) -> dict:
    """Write the flagged open shipments and their totals.

    The stored open shipments, the default, are rescored by difference; a given frame is scored in full.
    """
    pin_utc(spark)
    active = active_version(spark, root)
    model = ForestModel.load(spark, active.storage_path)
    if open_shipments is None:
        rows, scorer = rescore(spark, root, model, active.storage_path, as_of), lambda scored: scored
    else:
        rows, scorer = browse.in_transit(open_shipments), model
    flagged = stage(scoring.flagged_shipments(rows, scorer, as_of, model.threshold), "flagged")
    flagged.write.mode("overwrite").parquet(f"{root}/alerts/flagged")
    stats = scoring.alert_stats(flagged)
    stats.coalesce(1).write.mode("overwrite").json(f"{root}/alerts/stats")
    return stats.first().asDict()


def run_report(
    spark: SparkSession,
    root: str,
    week: Day | None = None,
    sellers: int | None = reporting.CRITICAL_SELLERS,
    flagged: int | None = reporting.FLAGGED_ROWS,
) -> str:
    """The four report tables of a week, by default the latest with data.

    ``sellers`` and ``flagged`` bound the two lists; None writes all their rows.
    """
    pin_utc(spark)
    if week is None:
        week = reporting.latest_data_date(kpi_daily_table(spark, root).read(), dt.date.today()).first().date
    monday = monday_of(week)
    weeks = [monday - dt.timedelta(days=7 * back) for back in range(8)]
    months = sorted({day.strftime("%Y-%m") for first in weeks for day in (first, first + dt.timedelta(days=6))})
    recent = shipments_table(spark, root).read(months)
    year, number, _ = monday.isocalendar()
    folder = f"{root}/report/{year}-W{number:02d}"
    tables = {
        "metrics": reporting.week_metrics(recent, monday),
        "otif_trend": reporting.week_otif_trend(recent, monday, bounded=True),
        "critical_sellers": reporting.critical_sellers(recent, monday, sellers),
        "flagged": reporting.late_of_week(recent, monday, flagged),
    }
    whole = {name for name, bound in (("critical_sellers", sellers), ("flagged", flagged)) if bound is None}
    for name, table in tables.items():  # lists with a bound have few rows
        (table if name in whole else table.coalesce(1)).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    return folder


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["etl", "retrain", "alerts", "report"])
    parser.add_argument("--tables", required=True)
    parser.add_argument("--raw")
    parser.add_argument("--as-of", default=dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"))
    parser.add_argument("--week")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--single-line", action="store_true", help="etl: no value holds a line break, so every file is split")
    parser.add_argument("--increment", action="store_true", help="etl: read only files that were not read before")
    parser.add_argument("--sellers", type=int, default=reporting.CRITICAL_SELLERS, help="0 for all")
    parser.add_argument("--flagged", type=int, default=reporting.FLAGGED_ROWS, help="0 for all")
    args = parser.parse_args(argv)
    spark = build_session(f"haulmark-{args.job}")
    try:
        if args.job == "etl" and args.increment:
            result = run_increment(spark, args.raw, args.tables, args.as_of)
        elif args.job == "etl":
            sources = csv_files.read_sources(spark, args.raw, multi_line=False if args.single_line else None)
            result = run_etl(spark, sources, csv_files.ORDINAL, args.tables, args.as_of)
        elif args.job == "retrain":
            result = run_retrain(spark, args.tables, args.as_of, force=args.force)
        elif args.job == "alerts":
            result = run_alerts(spark, args.tables, None, args.as_of)
        else:
            result = run_report(spark, args.tables, args.week, args.sellers or None, args.flagged or None)
    except (FileNotFoundError, ValueError, RuntimeError) as error:
        print(f"{args.job} failed: {error}", file=sys.stderr)
        return 1
    print(json.dumps(result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
