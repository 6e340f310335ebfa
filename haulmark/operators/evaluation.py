"""Splits, classification metrics and ranking quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haulmark.functions import numbers
from haulmark.staging import stage

HOLDOUT_SHARE = 0.10
HOLDOUT_MIN = 50
SCORE_STEPS = 10_000
OLDEST = "0001-01-01 00:00:00"
OPENED = 100_000  # rows that one task may sort to find a cut
PREFIX = 3  # characters added at each further narrowing


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Train and test frames with ``fraction`` of every class in test.

    Each class is cut at one exact md5 of key and seed, found from a histogram of at most 65,536
    buckets per class, so the split itself is a row-local filter that gives the same rows on
    every run and in every engine, and needs no sort.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    bucket = F.substring(digest, 1, 4)
    sizes = df.groupBy(F.col(label).alias("y"), bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    lower = W.partitionBy("y").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.select(
        "y",
        "b",
        F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"),
        "n",
        F.round(F.sum("n").over(W.partitionBy("y")) * F.lit(fraction)).cast("bigint").alias("wanted"),
    )
    holds_cut = (F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("n"))
    cuts = ranked.where(holds_cut).select("y", "b", (F.col("wanted") - F.col("before")).alias("rest")).collect()

    in_test: Column = F.lit(False)
    for cut in cuts:  # one per class
        here = df.where((F.col(label) == cut.y) & (bucket == cut.b)).select(digest.alias("h"))
        limit = here.orderBy("h").limit(cut.rest).agg(F.max("h")).first()[0]
        in_test = in_test | ((F.col(label) == cut.y) & (digest <= limit))
    return df.where(~in_test), df.where(in_test)


def newest_rows(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Older rows and the ``k`` newest by purchase time, ties by order id.

    The cut is narrowed by day, by second and by ever longer id prefixes, each step a small
    histogram, until at most ``OPENED`` rows share the cut's bucket and are sorted.
    """
    bought = F.coalesce(F.col("purchase_timestamp"), F.lit(OLDEST).cast("timestamp_ntz"))
    rows = df.select(bought.alias("ts"), "order_id")
    rest, held, used = k, None, 0
    day, second = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    steps = [day, second]
    while held is None or held > OPENED:
        if steps:
            step = steps.pop(0)
        else:
            longest = rows.agg(F.max(F.char_length("order_id"))).first()[0] or 0
            if used >= longest:
                break  # what is left differs by less than a second, or has one id
            used += PREFIX
            step = F.coalesce(F.substring("order_id", 1, used), F.lit(""))
        sizes = rows.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        newer = W.orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
        ranked = sizes.select("b", "n", F.coalesce(F.sum("n").over(newer), F.lit(0)).alias("before"))
        cut = ranked.where((F.col("before") < rest) & (F.col("before") + F.col("n") >= rest)).first()
        if cut is None:
            return df.limit(0), df
        rows, rest, held = rows.where(step == cut.b), rest - cut.before, cut.n
    tied = rows.orderBy(F.desc("ts"), F.desc("order_id")).limit(rest)
    last = tied.agg(F.min(F.struct(F.col("ts").cast("string").alias("ts"), "order_id"))).first()[0]
    mark = F.lit(last.ts).cast("timestamp_ntz")
    newest = (bought > mark) | ((bought == mark) & (F.col("order_id") >= last.order_id))
    return df.where(~newest), df.where(newest)


def holdout_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows and the newest tenth, at least fifty rows."""
    return newest_rows(df, max(HOLDOUT_MIN, int(df.count() * HOLDOUT_SHARE)))


def confusion(scored: DataFrame, threshold: float, score: str = "delay_probability", label: str = "label") -> DataFrame:
    """Counts and threshold metrics of the late class in one row; empty denominators give 0."""
    late, flagged = F.col(label) == 1, F.col(score) >= threshold
    counts = scored.agg(
        F.count_if(late & flagged).alias("tp"),
        F.count_if(~late & flagged).alias("fp"),
        F.count_if(late & ~flagged).alias("fn"),
        F.count_if(~late & ~flagged).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": numbers.ratio_or_zero(tp + tn, tp + fp + fn + tn),
            "precision_late": numbers.ratio_or_zero(tp, tp + fp),
            "recall_late": numbers.ratio_or_zero(tp, tp + fn),
            "f1_late": numbers.ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Per-class, macro and weighted precision, recall and F1 from a ``confusion`` row."""
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))

    def row(hit: Column, wrong: Column, missed: Column) -> dict[str, Column]:
        return {
            "precision": numbers.ratio_or_zero(hit, hit + wrong),
            "recall": numbers.ratio_or_zero(hit, hit + missed),
            "f1_score": numbers.ratio_or_zero(2 * hit, 2 * hit + wrong + missed),
            "support": hit + missed,
        }

    on_time, late = row(tn, fn, fp), row(tp, fp, fn)
    total = on_time["support"] + late["support"]
    accuracy = numbers.ratio_or_zero(tp + tn, total)
    metrics = ("precision", "recall", "f1_score")
    macro = {m: (on_time[m] + late[m]) / 2 for m in metrics}
    weighted = {
        m: numbers.ratio_or_zero(on_time[m] * on_time["support"] + late[m] * late["support"], total) for m in metrics
    }
    lines = {
        "on_time": on_time,
        "late": late,
        "accuracy": dict.fromkeys(metrics, accuracy) | {"support": total},
        "macro avg": macro | {"support": total},
        "weighted avg": weighted | {"support": total},
    }
    structs = [
        F.struct(F.lit(name).alias("class"), *[cells[m].alias(m) for m in (*metrics, "support")])
        for name, cells in lines.items()
    ]
    return counts.select(F.inline(F.array(*structs)))


def roc_auc(scored: DataFrame, score: str = "delay_probability", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties counted half.

    Rows shrink to one per distinct score. Ranks are running totals inside score buckets plus
    the total of lower buckets; scores lie in [0, 1], so there are at most ``SCORE_STEPS + 1``.
    """
    late = F.col(label) == 1
    counts = scored.groupBy(F.col(score).alias("s"), F.floor(F.col(score) * SCORE_STEPS).alias("b")).agg(
        F.count_if(late).alias("pos"), F.count_if(~late).alias("neg")
    )
    counts = stage(counts, "scores")  # read by both sides of the join below
    lower = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("b")
        .agg(F.sum("neg").alias("neg_in"))
        .select("b", F.coalesce(F.sum("neg_in").over(lower), F.lit(0)).alias("neg_before"))
    )
    inside = W.partitionBy("b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    placed = counts.withColumn("below", below).join(offsets, "b")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("below") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return placed.agg(F.try_divide(wins, pairs).alias("roc_auc"))
