"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Learning uses a bounded sample of labelled rows: at most ``SAMPLE`` rows of each label, the first by a hash of the id
(the bound is a parameter; the share of label 1 is counted over all labelled rows). Spark counts in how many sampled
texts of each label an n-gram slot occurs, the ``FEATURES`` most telling slots are kept, their log-count ratios scale
presence features, and a regularised logistic regression weighs them. Scoring reads every whole text.

Nulls: a null text is empty; empty texts get the score of the intercept. Rows with a null label or id, or whose id is
held out, teach nothing; ids labelled more than once count with their largest label. Without rows of both labels the
score is the share of label 1, or 0. Repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.char_grams import fold, held_out, take_by_hash
from haulmark.llm.common import U64, keep, releasing, slices, small_batches, texts_of

ORDERS = (3, 4, 5, 6)
BITS = 21
SAMPLE = 4_000
FEATURES = 8_192
THRESHOLD = 0.3
RUN = 100_000  # characters whose n-grams are held at a time


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, slot) of the n-grams of every order; those that reach over the end of a text are left out."""
    m = codes.astype(np.uint64) * U64(0x9E3779B97F4A7C15)
    m ^= m >> U64(29)
    h = np.zeros(len(m), np.uint64)
    inside = np.ones(len(m), bool)
    for order in range(1, ORDERS[-1] + 1):
        n = len(m) - order + 1
        if n <= 0:
            return
        h = h[:n] * U64(0xD6E8FEB86659FD93) + m[order - 1 :]
        inside = inside[:n] & (codes[order - 1 :] != 0)
        if order in ORDERS:
            start = np.flatnonzero(inside)
            x = h[start] * U64(0xA0761D6478BD642F + 2 * order)
            yield start, ((x ^ (x >> U64(32))) * U64(0xE7037ED1A0B428DB) >> U64(64 - BITS)).astype(np.int64)


def _present(texts: list[str], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; features are slots, or what ``wanted`` maps them to where that is positive."""
    codes, _, ends = fold(texts)
    docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for start, slot in grams(codes):
        if wanted is not None:
            slot = wanted[slot]
            hit = np.flatnonzero(slot >= 0)
            start, slot = start[hit], slot[hit].astype(np.int64)
        docs.append(np.searchsorted(ends, start))
        found.append(slot)
    pairs = np.unique(np.concatenate(docs) << BITS | np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label each slot occurs, summed over the task."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        texts, labels, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        for some in slices(texts, RUN):
            doc, slot = _present(some, None)
            toxic = np.array(labels[at : at + len(some)], bool)[doc]
            np.add.at(counts[1], slot[toxic], 1)
            np.add.at(counts[0], slot[~toxic], 1)
            at += len(some)
    slots = np.flatnonzero(counts.any(0))
    for part in np.array_split(slots, max(1, len(slots) // 200_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), *(pa.array(counts[i][part].astype(np.int64)) for i in (1, 0))], names=["slot", "toxic", "clean"]
        )


@dataclass
class Model:
    wanted: np.ndarray  # slot -> feature, -1 for the rest
    weights: np.ndarray  # with the log-count ratios multiplied in
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if len(self.weights):
            doc, feature = _present(texts, self.wanted)
            out += np.bincount(doc, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _logistic(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: np.ndarray, n: int) -> tuple:
    """Weights and intercept by accelerated gradient descent with an L2 penalty; the classes weigh alike."""
    weight = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum())
    x = value[feature]
    norm = np.bincount(doc, x * x, len(labels)).max(initial=1.0)
    step, penalty = 1 / (0.25 * norm + 1e-3), 1e-5
    w, b, ahead, ahead_b = np.zeros(n), 0.0, np.zeros(n), 0.0
    for t in range(400):
        z = np.bincount(doc, ahead[feature] * x, len(labels)) + ahead_b
        slack = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels)
        new = ahead - step * 20 * (np.bincount(feature, slack[doc] * x, n) + penalty * ahead)
        new_b = ahead_b - step * 20 * slack.sum()
        pace = t / (t + 3)
        w, ahead = new, new + pace * (new - w)
        b, ahead_b = new_b, new_b + pace * (new_b - b)
    return w * value, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    seen = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = seen.get(True, 0) / max(1, sum(seen.values()))
    none = Model(np.full(1 << BITS, -1, np.int16), np.zeros(0), float(np.log(share / (1 - share)) if 0 < share < 1 else 50 * (2 * share - 1)))
    if len(seen) < 2:
        return none
    ids = take_by_hash(known.where("toxic"), sample).union(take_by_hash(known.where("not toxic"), sample))
    learned = keep(texts_of(docs).join(F.broadcast(ids), "doc_id").select("text", "toxic"), "toxic-sample")
    size = {r[0]: r[1] for r in learned.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return none
    a, b = F.col("toxic") / size[True], F.col("clean") / size[False]
    mean = (F.col("toxic") + F.col("clean")) / (size[True] + size[False])
    counted = learned.mapInArrow(releasing(_count), "slot long, toxic long, clean long").groupBy("slot").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    tell = F.pow(a - b, 2) / (mean * (1.0001 - mean))
    top = counted.where("toxic + clean >= 3").orderBy(tell.desc(), "slot").limit(features).collect()
    wanted = np.full(1 << BITS, -1, np.int16)
    wanted[[r.slot for r in top]] = np.arange(len(top))
    ratio = np.log([(r.toxic + 1) / (size[True] + 2) for r in top]) - np.log(
        [(r.clean + 1) / (size[False] + 2) for r in top]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some in slices(texts, RUN):
                doc, feature = _present(some, wanted)
                cut = np.searchsorted(doc, np.arange(len(some) + 1))
                raw = feature.astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[at : at + len(some)]), pa.array([raw[2 * s : 2 * e] for s, e in zip(cut, cut[1:])])],
                    names=["toxic", "features"],
                )
                at += len(some)

    rows = learned.mapInArrow(releasing(encode), "toxic boolean, features binary").collect()  # 2 * sample rows at most
    sets = [np.frombuffer(bytes(r.features), "<i2").astype(np.int64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(s) for s in sets])
    truth = np.array([r.toxic for r in rows])
    weights, intercept = _logistic(doc, np.concatenate(sets), ratio, truth, len(top))
    return Model(wanted, weights, float(intercept + np.log(share / (1 - share))))


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [model.value.scores(some) for some in slices(texts, RUN)]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"]
            )

    return run


def scored(docs: DataFrame, model: Model, *columns) -> DataFrame:
    """The given columns of every row and the score of its whole text."""
    small_batches(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    given = docs.select(text, *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[1:])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB of slots and the weights, whatever the input
    return given.mapInArrow(releasing(_score(shared)), f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = scored(docs, train(docs, labels, sample), doc_id, held_out().alias("held_out"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows below the threshold, with their columns; all of them where the labels teach no feature."""
    model = train(docs, labels)
    if not len(model.weights):
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return scored(docs, model, row).where(F.col("score") < THRESHOLD).select("row.*")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
