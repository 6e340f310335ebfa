"""Model inputs: imputation, label codes, the feature matrix and class weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import numbers
from haulmark.operators.lookups import lookup_stored
from haulmark.schemas import FEATURE_COLUMNS, LABEL_COLUMN
from haulmark.staging import stage

# --- Fixed values: training minimum, encoded columns and inference defaults. --------------
MIN_ROWS = 100
UNKNOWN = "unknown"
UNSEEN_CODE = -1
ENCODED = {"category_name": "category_encoded", "seller_state": "seller_state_encoded"}
NUMERIC_DEFAULTS = {
    "distance_km": 0.0,
    "seller_historical_delay_rate": 0.0,
    "day_of_week": 0.0,
    "month": 1.0,
    "freight_value": 0.0,
    "price": 0.0,
}

# Distances end at half the meridian, so steps of 0.1 km give at most about 200,000 buckets.
DISTANCE_STEP = 0.1

# Vocabularies of up to so many values become literals.
LISTED = 1_000


def require_training_rows(df: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"Too few labelled shipments to fit a model: {found}, where {minimum} are needed.")
    return df


def exact_median(df: DataFrame, column: str, step: float) -> DataFrame:
    """One row with the interpolated median.

    Spark's own exact median keeps every distinct value in one task. Here equal values are
    counted first, the counts are summed into buckets of width ``step`` and only the bucket
    holding the middle is opened. The range of ``column`` over ``step`` bounds the one
    unpartitioned window.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.floor(F.col("v") / step).alias("b")
    lower = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    sums = counts.groupBy(bucket).agg(F.sum("n").alias("in_bucket"))
    ranked = sums.select(
        "b",
        "in_bucket",
        F.coalesce(F.sum("in_bucket").over(lower), F.lit(0)).alias("before"),
        F.sum("in_bucket").over(W.partitionBy()).alias("total"),
    )

    def holds_middle(start: Column, size: Column) -> Column:
        left, right = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
        return ((start < left) & (left <= start + size)) | ((start < right) & (right <= start + size))

    middle = ranked.where(holds_middle(F.col("before"), F.col("in_bucket")))
    inside = W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    opened = counts.withColumn("b", bucket).join(F.broadcast(middle), "b")  # one or two rows
    start = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return (
        opened.withColumn("start", start)
        .where(holds_middle(F.col("start"), F.col("n")))
        .agg(F.avg("v").alias("median"))
    )


def imputation_stats(df: DataFrame) -> DataFrame:
    """Median distance and mean seller rate of the given rows.

    The two columns are written once: the median alone reads them three times.
    """
    df = stage(df.select("distance_km", "seller_historical_delay_rate"), "imputation")
    return df.agg(numbers.mean(F.col("seller_historical_delay_rate")).alias("rate_mean")).select(
        exact_median(df, "distance_km", DISTANCE_STEP).scalar().alias("distance_median"), "rate_mean"
    )


@dataclass(frozen=True)
class Imputation:
    distance_median: float | None
    rate_mean: float | None

    @classmethod
    def fit(cls, df: DataFrame) -> Imputation:
        return cls(**imputation_stats(df).first().asDict())

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "distance_km": F.coalesce("distance_km", F.lit(self.distance_median).cast("double")),
                "seller_historical_delay_rate": F.coalesce(
                    "seller_historical_delay_rate", F.lit(self.rate_mean).cast("double")
                ),
            }
        )


def text_value(column: str) -> Column:
    return F.coalesce(column, F.lit(UNKNOWN))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` and their position in sorted order.

    The unpartitioned window only sees the distinct values.
    """
    values = df.select(text_value(column).alias("value")).distinct()
    code = F.row_number().over(W.orderBy("value")) - 1
    return values.select(F.lit(column).alias("column"), "value", code.alias("code"))


def vocabularies(df: DataFrame) -> DataFrame:
    """The codes of all encoded columns as one table, read from one pass over ``df``."""
    df = df.select(*ENCODED).distinct()
    first, *rest = [vocabulary(df, column) for column in ENCODED]
    for other in rest:
        first = first.unionByName(other)
    return first


def encode(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add the code columns; a value outside the vocabulary gets -1.

    A vocabulary of up to ``LISTED`` values is a literal in the row-local expression, so the rows
    are not shuffled by a column of few values. A larger one is joined.
    """
    vocab = stage(vocab, "vocabulary")
    for column, encoded in ENCODED.items():
        codes = vocab.where(F.col("column") == column).select("value", "code")
        listed = sorted((row.code, row.value) for row in codes.limit(LISTED + 1).collect())
        if len(listed) <= LISTED and [code for code, _ in listed] == list(range(len(listed))):
            values = F.lit([value for _, value in listed]).cast("array<string>")
            place = F.array_position(values, text_value(column)).cast("int")  # 0 where absent
            df = df.withColumn(encoded, F.when(place > 0, place - 1).otherwise(UNSEEN_CODE))
            continue
        codes = codes.select(F.col("value").alias("_value"), F.col("code").alias(encoded))
        df = lookup_stored(df.withColumn("_value", text_value(column)), codes, "_value").drop("_value")
        df = df.withColumn(encoded, F.coalesce(encoded, F.lit(UNSEEN_CODE)))
    return df


def _as_features() -> list[Column]:
    return [F.col(name).cast("double").alias(name) for name in FEATURE_COLUMNS]


def feature_matrix(df: DataFrame, imputation: Imputation, vocab: DataFrame, *keep: str) -> DataFrame:
    """The eight training columns in order and the 0/1 label; ``keep`` carries row keys along."""
    encoded = encode(imputation.apply(df), vocab)
    return encoded.select(*keep, *_as_features(), F.col(LABEL_COLUMN).cast("int").alias("label"))


def inference_matrix(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """All columns of ``df`` plus a ``features`` struct with defaults for missing inputs."""
    missing = {name: F.lit(None).cast("string") for name in ENCODED if name not in df.columns}
    coded = encode(df.withColumns(missing) if missing else df, vocab)

    def value(name: str) -> Column:
        if name not in NUMERIC_DEFAULTS:
            return F.col(name).cast("double")
        default = F.lit(NUMERIC_DEFAULTS[name])
        return F.coalesce(F.col(name).cast("double"), default) if name in df.columns else default

    features = F.struct(*[value(name).alias(name) for name in FEATURE_COLUMNS])
    return coded.withColumn("features", features).select(*df.columns, "features")


def class_weights(labelled: DataFrame) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everything = W.partitionBy()  # two rows
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return sizes.select("label", "n", weight.alias("weight"))
