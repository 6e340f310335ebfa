import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.operators import audit, registry, scoring
from haulmark.operators import evaluation as ev
from haulmark.operators import features as ft
from haulmark.operators.forest import ForestModel, train_model
from haulmark.schemas import FEATURE_COLUMNS

DDL = (
    "order_id string, seller_id string, customer_state string, distance_km double,"
    " seller_historical_delay_rate double, day_of_week int, month int, category_name string, seller_state string,"
    " freight_value double, price double, is_late boolean, delay_days double, estimated_delivery timestamp_ntz,"
    " order_status string, purchase_timestamp timestamp_ntz"
)


@pytest.fixture(scope="module")
def shipments(spark):
    """Two hundred rows, forty late, with a few missing inputs."""
    rng = random.Random(42)
    rows = []
    for i in range(200):
        late = i % 5 == 0
        rate = rng.uniform(0.3, 0.5) if late else rng.uniform(0.0, 0.35)
        when = dt.datetime(2023, 1, 1) + dt.timedelta(hours=6 * i)
        rows.append((
            f"order_{i:04d}", f"seller_{i % 10}", ("MG", "BA")[i % 2], None if i < 20 else rng.uniform(100, 2000),
            None if 10 <= i < 30 else rate, i % 7, i % 12 + 1, ("electronics", "furniture")[i % 2], ("SP", "RJ")[i % 2],
            rng.uniform(5, 100), rng.uniform(20, 500), late, 3.0 if late else -2.0, when,
            ("shipped", "created", "delivered")[i % 3], when,
        ))
    return spark.createDataFrame(rows, DDL).cache()


@pytest.fixture(scope="module")
def training(shipments):
    return train_model(shipments, threshold=0.4, numTrees=10, maxDepth=5)


def test_matrix_columns_and_imputation(shipments):
    stats = ft.Imputation.fit(shipments)
    known = [r.distance_km for r in shipments.collect() if r.distance_km is not None]
    assert stats.distance_median == pytest.approx(statistics.median(known))
    matrix = ft.feature_matrix(shipments, stats, ft.vocabularies(shipments))
    assert matrix.columns == [*FEATURE_COLUMNS, "label"]
    assert matrix.where(F.col("distance_km").isNull()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_median_matches_brute_force(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.uniform(0, 3000), 250.0, 250.05]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert ft.exact_median(df, "v", 0.1).first().median == pytest.approx(statistics.median(values))


def test_too_few_rows(shipments):
    with pytest.raises(ValueError, match="100"):
        train_model(shipments.limit(50))


def test_unseen_values_and_defaults(spark, shipments):
    row = spark.createDataFrame([("TOTALLY_UNSEEN_CATEGORY_XYZ", "ZZ")], "category_name string, seller_state string")
    got = ft.inference_matrix(row, ft.vocabularies(shipments)).select("features.*").first()
    assert list(got.asDict()) == FEATURE_COLUMNS
    assert tuple(got) == (0.0, 0.0, 0.0, 1.0, -1.0, -1.0, 0.0, 0.0)


def test_codes_follow_sorted_values(shipments):
    vocab = {(r.column, r.value): r.code for r in ft.vocabularies(shipments).collect()}
    assert vocab[("category_name", "electronics")] == 0 and vocab[("seller_state", "SP")] == 1


def test_training_result(training):
    assert set(training.metrics) == {"accuracy", "precision_late", "recall_late", "f1_late", "roc_auc"}
    assert all(0 <= v <= 1 for v in training.metrics.values())
    assert (training.train_size, training.test_size) == (160, 40)
    importances = training.model.importances()
    assert set(importances) == set(FEATURE_COLUMNS) and sum(importances.values()) == pytest.approx(1.0)
    ranked = [r.importance for r in training.model.ranked_importances().collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_scoring_keeps_rows_and_threshold(training, shipments):
    scored = scoring.predict_batch(shipments, training.model, 0.4).collect()
    assert len(scored) == 200
    assert all(0 <= r.delay_probability <= 1 and r.predicted_late == (r.delay_probability >= 0.4) for r in scored)
    empty = scoring.predict_batch(shipments.limit(0), training.model, 0.4)
    assert empty.count() == 0 and "predicted_late" in empty.columns


def test_saved_model_scores_the_same(spark, training, shipments, tmp_path):
    training.model.save(str(tmp_path / "model"))
    loaded = ForestModel.load(spark, str(tmp_path / "model"))
    assert loaded.threshold == 0.4
    before, after = (
        {r.order_id: r.delay_probability for r in model(shipments).collect()} for model in (training.model, loaded)
    )
    assert before == after


def test_flagged_are_active_and_sorted(training, shipments):
    flagged = scoring.flagged_shipments(shipments, training.model, "2023-01-15 12:00:00", 0.01).collect()
    delivered = {r.order_id for r in shipments.where("order_status = 'delivered'").collect()}
    assert flagged and not delivered & {r.order_id for r in flagged}
    risks = [r.delay_probability for r in flagged]
    assert risks == sorted(risks, reverse=True)
    without_status = scoring.flagged_shipments(shipments.drop("order_status"), training.model, "2023-01-15", 0.0)
    assert without_status.count() == 200
    stats = scoring.alert_stats(without_status.limit(0)).first()
    assert tuple(stats) == (0, 0, 0, 0.0)


def test_requests_are_checked(spark, training):
    ddl = (
        "distance_km double, category_name string, seller_state string, day_of_week int, freight_value double,"
        " price double, month int, seller_historical_delay_rate double"
    )
    good = (500.0, "electronics", "SP", 4, 25.0, 299.99, None, None)
    bad = (-1.0, None, "SP", 7, 25.0, 299.99, 13, 1.5)
    answered, refused = scoring.score_requests(spark.createDataFrame([good, bad], ddl), training.model)
    row = answered.first()
    assert (row.month, row.seller_historical_delay_rate) == (1, 0.1) and row.risk_level in ("low", "medium", "high")
    assert refused.first().violations == ["distance_km", "day_of_week", "month", "seller_historical_delay_rate", "category_name"]
    assert audit.input_violations(spark.createDataFrame([good], ddl)).first().violations == []


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(10_007).select(F.col("id").cast("string").alias("k"), (F.col("id") % 9 == 0).cast("int").alias("y"))
    train, test = ev.stratified_split(df, "y", "k", 0.2, 42)
    sizes = {r.y: r["count"] for r in test.groupBy("y").count().collect()}
    assert sizes == {1: round(1112 * 0.2), 0: round(8895 * 0.2)}
    assert train.join(test, "k").count() == 0 and train.count() + test.count() == 10_007
    again = ev.stratified_split(df.repartition(5), "y", "k", 0.2, 42)[1]
    assert again.exceptAll(test).count() == 0


def test_ids_of_one_prefix_on_one_day(spark, monkeypatch):
    monkeypatch.setattr(ev, "OPENED", 5)
    rows = [(dt.datetime(2024, 1, 1), f"ORDER-{i:04d}") for i in range(300)]
    _, newest = ev.newest_rows(spark.createDataFrame(rows, "purchase_timestamp timestamp_ntz, order_id string"), 37)
    assert sorted(r.order_id for r in newest.collect()) == [f"ORDER-{i:04d}" for i in range(263, 300)]


def test_codes_need_no_join_while_they_are_few(shipments, monkeypatch):
    vocab = ft.vocabularies(shipments)
    listed = ft.encode(shipments, vocab)
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ft, "LISTED", 1)
    joined = ft.encode(shipments, vocab)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert listed.exceptAll(joined).count() == 0 and joined.count() == listed.count()


@pytest.mark.parametrize("k", [1, 50, 333, 999, 1000, 5000])
def test_newest_rows_match_brute_force(spark, k):
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (None if i % 97 == 0 else start + dt.timedelta(days=rng.randrange(5), seconds=rng.choice([0, 0, rng.randrange(9)])), f"{i:05d}")
        for i in range(1000)
    ]
    df = spark.createDataFrame(rows, "purchase_timestamp timestamp_ntz, order_id string")
    older, newest = ev.newest_rows(df, k)
    expected = sorted(rows, key=lambda r: (r[0] or dt.datetime(1, 1, 1), r[1]), reverse=True)[:k]
    assert sorted(r.order_id for r in newest.collect()) == sorted(i for _, i in expected)
    assert older.count() == 1000 - len(expected)


def test_auc_and_report_match_brute_force(spark):
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 600)
    score = np.clip(np.round(label * 0.2 + rng.random(600) * 0.8, 2), 0, 1)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label, strict=True)], "delay_probability double, label int")
    pos, neg = score[label == 1], score[label == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(pairs / (len(pos) * len(neg)))
    counts = ev.confusion(df, 0.5)
    row, flagged = counts.first(), score >= 0.5
    assert row.tp == (flagged & (label == 1)).sum() and row.accuracy == pytest.approx((flagged == (label == 1)).mean())
    report = {r["class"]: r for r in ev.classification_report(counts).collect()}
    assert report["late"].f1_score == pytest.approx(row.f1_late)
    assert report["weighted avg"].recall == pytest.approx(row.accuracy)
    nothing = ev.confusion(df, 2.0).first()
    assert (nothing.precision_late, nothing.recall_late, nothing.f1_late) == (0.0, 0.0, 0.0)


VERSIONS = "version string, trained_at timestamp_ntz, accuracy double, is_active boolean"


@pytest.mark.parametrize(
    ("versions", "minimum", "reason", "retrain"),
    [
        ([], 500, "no_active_model", True),
        ([("v1", dt.datetime(2023, 1, 10), 0.9, True)], 100, "new_rows", True),
        ([("v1", dt.datetime(2024, 1, 10), 0.81, True), ("v2", dt.datetime(2024, 2, 1), 0.1, False)], 500, "up_to_date", False),
        ([("v1", dt.datetime(2024, 1, 10), 0.5, True)], 500, "late_rate_drift", True),
        ([("v1", dt.datetime(2024, 1, 10), 0.77, True)], 500, "low_accuracy", True),
    ],
)
def test_retrain_decision(spark, shipments, versions, minimum, reason, retrain):
    rows = shipments.withColumn("created_at", F.col("purchase_timestamp"))
    row = registry.retrain_decision(rows, spark.createDataFrame(versions, VERSIONS), "2023-02-19 18:00:00", minimum).first()
    assert (row.reason, row.retrain) == (reason, retrain)


def test_no_recent_rows_means_no_retraining(spark, shipments):
    rows = shipments.withColumn("created_at", F.col("purchase_timestamp"))
    versions = spark.createDataFrame([("v1", dt.datetime(2024, 1, 10), 0.1, True)], VERSIONS)
    row = registry.retrain_decision(rows, versions, "2030-01-01 00:00:00").first()
    assert (row.reason, row.retrain) == ("no_recent_rows", False)
