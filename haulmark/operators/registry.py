"""Model versions, experiment records and the retraining decision."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions import numbers
from haulmark.schemas import MODEL_RUNS, MODEL_VERSIONS

# --- Fixed values: retraining limits. -----------------------------------------------------
MIN_NEW_ROWS = 500
RECENT_DAYS = 30
MAX_DRIFT = 0.22
MIN_ACCURACY = 0.78


def active_version(versions: DataFrame) -> DataFrame:
    """The newest active version, or no row."""
    newest = F.max_by(F.struct(*versions.columns), F.struct("trained_at", "version"))
    picked = versions.where(F.col("is_active")).agg(newest.alias("_row"))
    return picked.where(F.col("_row").isNotNull()).select("_row.*")


def retrain_decision(
    shipments: DataFrame, versions: DataFrame, as_of: str, min_new_rows: int = MIN_NEW_ROWS
) -> DataFrame:
    """One row: whether to retrain, why, and the figures behind it.

    ``late_rate_drift`` is the gap between the stored accuracy and the recent on-time share, a
    stand-in for accuracy on fresh rows. The active version, one row, is read once, before the shipments.
    """
    found = active_version(versions).first()
    kinds = {"version": "string", "accuracy": "double", "trained_at": "timestamp_ntz"}
    active = {name: F.lit(found[name] if found else None).cast(kind) for name, kind in kinds.items()}
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = F.col("purchase_timestamp") >= now - F.make_dt_interval(days=F.lit(RECENT_DAYS))
    figures = shipments.agg(
        F.count_if(F.col("created_at") > active["trained_at"]).alias("new_rows"),
        F.count_if(recent).alias("recent_rows"),
        numbers.mean(F.col("is_late").cast("int"), where=recent).alias("recent_late_rate"),
    ).select(
        active["version"].alias("active_version"),
        active["accuracy"].alias("stored_accuracy"),
        "new_rows",
        "recent_rows",
        "recent_late_rate",
    )
    drift = F.abs(F.col("stored_accuracy") - (1 - F.col("recent_late_rate")))
    reason = (
        F.when(F.col("active_version").isNull(), "no_active_model")
        .when(F.col("new_rows") >= min_new_rows, "new_rows")
        .when(F.col("recent_rows") == 0, "no_recent_rows")
        .when(F.col("late_rate_drift") > MAX_DRIFT, "late_rate_drift")
        .when(F.col("stored_accuracy") < MIN_ACCURACY, "low_accuracy")
        .otherwise("up_to_date")
    )
    return (
        figures.withColumn("late_rate_drift", drift)
        .withColumn("reason", reason)
        .withColumn("retrain", ~F.col("reason").isin("no_recent_rows", "up_to_date"))
    )


def append_rows(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    """Add a few records to an append-only Parquet table."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def log_run(spark: SparkSession, root: str, run: dict) -> None:
    """Record one experiment; only numeric metrics are kept."""
    metrics = {k: float(v) for k, v in run["metrics"].items() if isinstance(v, int | float)}
    params = {k: str(v) for k, v in run["params"].items()}
    row = (run["run_id"], run["run_name"], run["logged_at"], params, metrics, run["importances"], run["artifact_uri"])
    append_rows(spark, f"{root}/runs", MODEL_RUNS, [row])


def promote(spark: SparkSession, root: str, run: dict, promoted_at: dt.datetime) -> None:
    """Record a promotion. The newest promotion is the active version; older ones stay on record."""
    metrics = run["metrics"]
    scores = [float(metrics[name]) for name in ("accuracy", "precision_late", "recall_late", "f1_late")]
    note = f"run {run['run_id']} became the active model"
    row = (run["run_id"], promoted_at, *scores, float(run["params"]["threshold"]), True, run["artifact_uri"], note)
    append_rows(spark, f"{root}/versions", MODEL_VERSIONS, [row])


def read_versions(spark: SparkSession, root: str) -> DataFrame:
    """All promotions with ``is_active`` true for the newest only; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MODEL_VERSIONS)
    rows = spark.read.schema(MODEL_VERSIONS).parquet(f"{root}/versions")
    newest = rows.agg(F.max(F.struct("trained_at", "version"))).scalar()
    return rows.withColumn("is_active", F.struct("trained_at", "version") == newest)
