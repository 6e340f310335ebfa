"""The late-delivery classifier on Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.operators import evaluation as ev
from haulmark.operators import features as ft
from haulmark.schemas import DEFAULT_THRESHOLD, FEATURE_COLUMNS
from haulmark.staging import stage

# --- Fixed values: forest settings. -------------------------------------------------------
FOREST = {
    "numTrees": 300,
    "maxDepth": 12,
    "minInstancesPerNode": 5,
    "featureSubsetStrategy": "sqrt",
    "seed": 42,
}
TEST_SHARE = 0.2
INPUTS = ["category_name", "seller_state", *ft.NUMERIC_DEFAULTS]


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="_vector").transform(df)


def _probability(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """``df`` with ``delay_probability`` from its feature columns."""
    scored = model.transform(_assembled(df))
    late = vector_to_array("probability")[1].alias("delay_probability")
    return scored.select(*[F.col(name) for name in df.columns], late)


@dataclass
class ForestModel:
    """A fitted forest with its codes and threshold; calling it scores a frame."""

    forest: RandomForestClassificationModel
    vocab: DataFrame
    threshold: float = DEFAULT_THRESHOLD

    def __call__(self, df: DataFrame) -> DataFrame:
        inputs = ft.inference_matrix(df, self.vocab)
        carried = F.struct(*[F.col(name) for name in df.columns]).alias("_row")
        scored = _probability(self.forest, inputs.select(carried, "features.*"))
        return scored.select("_row.*", "delay_probability")

    def importances(self) -> dict[str, float]:
        return dict(zip(FEATURE_COLUMNS, self.forest.featureImportances.toArray().tolist(), strict=True))

    def ranked_importances(self, n: int = 10) -> DataFrame:
        spark = self.vocab.sparkSession
        rows = spark.createDataFrame(list(self.importances().items()), "feature string, importance double")
        return rows.orderBy(F.desc("importance"), "feature").limit(n).withColumn("importance", F.round("importance", 6))

    def save(self, path: str) -> None:
        spark = self.vocab.sparkSession
        self.forest.write().overwrite().save(f"{path}/forest")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        about = [(json.dumps({"threshold": self.threshold}),)]
        spark.createDataFrame(about, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        self.ranked_importances(len(FEATURE_COLUMNS)).coalesce(1).write.mode("overwrite").json(f"{path}/importances")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        vocab = spark.read.parquet(f"{path}/vocab")
        return cls(RandomForestClassificationModel.load(f"{path}/forest"), vocab, about["threshold"])


@dataclass
class Training:
    model: ForestModel
    metrics: dict[str, float]
    report: DataFrame
    train_size: int
    test_size: int
    params: dict = field(default_factory=dict)


def train_model(
    shipments: DataFrame, threshold: float = DEFAULT_THRESHOLD, test_share: float = TEST_SHARE, **settings
) -> Training:
    """Fit on a stratified train part and measure on the rest. ``settings`` override ``FOREST``.

    The feature matrix is written once; split, fit and evaluation then read eight numbers a row.
    """
    rows = stage(shipments.select("order_id", *INPUTS, "is_late"), "training")
    ft.require_training_rows(rows)
    vocab = stage(ft.vocabularies(rows).coalesce(1), "vocab")
    matrix = stage(ft.feature_matrix(rows, ft.Imputation.fit(rows), vocab, "order_id"), "matrix")
    params = FOREST | settings
    train, test = ev.stratified_split(matrix, "label", "order_id", test_share, params["seed"])

    weights = {row.label: row.weight for row in ft.class_weights(train).collect()}  # two classes
    weight = F.when(F.col("label") == 1, F.lit(weights.get(1, 1.0))).otherwise(F.lit(weights.get(0, 1.0)))
    classifier = RandomForestClassifier(
        featuresCol="_vector", labelCol="label", weightCol="_weight", maxMemoryInMB=1024, **params
    )
    forest = classifier.fit(_assembled(train.withColumn("_weight", weight)).select("_vector", "label", "_weight"))

    scored = stage(_probability(forest, test).select("delay_probability", "label"), "evaluation")
    counts = ev.confusion(scored, threshold)
    figures = counts.select("*", ev.roc_auc(scored).scalar().alias("roc_auc")).first().asDict()
    test_size = sum(figures.pop(name) for name in ("tp", "fp", "fn", "tn"))
    return Training(
        ForestModel(forest, vocab, threshold),
        figures,
        ev.classification_report(counts),
        train.count(),
        test_size,
        params | {"threshold": threshold, "class_weight": "balanced"},
    )
