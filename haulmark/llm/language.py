"""Language identification by interpolated Kneser-Ney character models.

One model of order ``ORDER`` per language, learned from a bounded sample: about ``SAMPLE_CHARS`` characters of each
language, whole texts picked by a hash of the id (the bound is a parameter), at least one text of each language that has
one with a letter. Texts are folded to lower-case letters
and blanks. Log probabilities of the n-grams that any language has seen, and back-off weights of contexts, are kept in
arrays sorted by hash, one row for an n-gram and one column for a language, and found through a bucket index.
The language with the lowest cross-entropy per character wins. A text is marked as rejected when its best
cross-entropy is above what all but a thousandth of the sampled texts of that language show.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows without a language teach nothing; without
any, all texts are ``und``. Repeated rows are treated alike; ties go to the language first in order; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.char_grams import fold, held_out, is_letter
from haulmark.llm.common import U64, keep, mix, slices, texts_of

ORDER = 4
SAMPLE_CHARS = 2_000_000
UNKNOWN = "und"


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes with everything but letters blank, starts, ends, and how many letters each text has."""
    codes, start, end = fold(texts)
    letter = is_letter(codes)
    total = np.r_[0, np.cumsum(letter)]
    codes = np.where(letter, np.minimum(codes, 0xFFFF), np.where(codes == 0, 0, 32)).astype(np.uint64)
    return codes, start, end, total[end] - total[start]


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The n-gram of ``ORDER`` codes that ends at each position, 16 bits a code; before the first of a text stand zeros."""
    padded = np.r_[np.zeros(ORDER - 1, np.uint64), codes]
    key, inside = codes.astype(np.uint64), codes != 0
    for i in range(1, ORDER):
        before = padded[ORDER - 1 - i : ORDER - 1 - i + len(codes)]
        inside &= before != 0
        key |= np.where(inside, before, U64(0)) << U64(16 * i)
    return key


def _within(codes: np.ndarray) -> np.ndarray:
    """Positions of all texts but the blank that each begins with, and repeated blanks (runs of blanks count once)."""
    ok = codes != 0
    ok[:1] = False
    ok[1:] &= (codes[:-1] != 0) & ((codes[1:] != 32) | (codes[:-1] != 32))
    return ok


class HashArray:
    """Rows by key: hashes in ascending order, with the place where each run of leading bits begins."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        hashes = mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order].astype(np.float32)
        self.shift = U64(64 - max(8, int(len(keys)).bit_length() + 1))
        marks = self.hashes >> self.shift
        size = 1 << (64 - int(self.shift))
        self.begin = np.searchsorted(marks, np.arange(size + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.begin).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        h = mix(keys)
        bucket = (h >> self.shift).astype(np.int64)
        at = self.begin[bucket]
        out = np.full(len(h), -1, np.int32)
        if not len(self.hashes):
            return out
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (self.begin[bucket + 1] - at > 1))
        for step in range(1, self.longest):
            if not len(left):
                break
            place = at[left] + step
            ok = place < self.begin[bucket[left] + 1]
            left, place = left[ok], place[ok]
            hit = self.hashes[place] == h[left]
            out[left[hit]] = place[hit]
            left = left[~hit]
        return out


def _kneser_ney(key: np.ndarray, count: np.ndarray, order: int, lower: tuple | None, size: int) -> tuple:
    """Probabilities of an order's n-grams and back-off weights of its contexts, for one language.

    Returns (keys, probabilities, contexts, weights, probability function).
    """
    ones, twos = (count == 1).sum(), (count == 2).sum()
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    context = key >> U64(16)
    contexts, where = np.unique(context, return_inverse=True)
    total = np.bincount(where, count)
    back = discount * np.bincount(where) / total
    tail = key & U64((1 << 16 * (order - 1)) - 1)
    below = lower(tail) if lower else np.full(len(key), 1 / size)
    p = (count - discount) / total[where] + back[where] * below

    def probability(asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        c = asked >> U64(16)
        cat = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
        weight = np.where(contexts[cat] == c, back[cat], 1.0)
        tails = asked & U64((1 << 16 * (order - 1)) - 1)
        rest = lower(tails) if lower else np.full(len(asked), 1 / size)
        return np.where(key[at] == asked, p[at], weight * rest)

    return key, contexts, back, probability


@dataclass
class Model:
    languages: list[str]
    grams: list[HashArray] = field(default_factory=list)  # highest order first
    backs: list[HashArray] = field(default_factory=list)  # log back-off weights of contexts
    floor: np.ndarray | None = None  # log probability of an unseen character
    limit: dict[str, float] = field(default_factory=dict)

    def entropies(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per text and language, and the number of characters judged."""
        where = np.flatnonzero(_within(codes))
        total = np.zeros((len(start), len(self.languages)))
        n = np.searchsorted(where, end) - np.searchsorted(where, start)
        for part in range(0, len(where), 400_000):
            at = where[part : part + 400_000]
            key = keys_of(codes[max(0, at[0] - ORDER + 1) : at[-1] + 1])[at - max(0, at[0] - ORDER + 1)]
            logs = np.zeros((len(at), len(self.languages)), np.float32)
            left = np.arange(len(at))
            for depth, (grams, backs) in enumerate(zip(self.grams, self.backs)):
                order = ORDER - depth
                asked = key[left] & U64((1 << 16 * order) - 1) if order < 4 else key[left]
                row = grams.find(asked)
                hit = row >= 0
                logs[left[hit]] += grams.rows[row[hit]]
                left, asked = left[~hit], asked[~hit]
                row = backs.find(asked >> U64(16))
                known = row >= 0
                logs[left[known]] += backs.rows[row[known]]
            logs[left] += self.floor
            doc = np.searchsorted(end, at)
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[first]] += np.add.reduceat(logs.astype(np.float64), first, axis=0)
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy of the best, and whether it is rejected."""
        codes, start, end, letters = letters_of(texts)
        entropy, n = self.entropies(codes, start, end)
        best = entropy.argmin(1)
        gap = entropy - entropy.min(1, keepdims=True)
        # As many characters as carry independent evidence: the square root damps their dependence.
        score = 1 / np.exp(-gap * np.sqrt(np.maximum(n, 1))[:, None] * 4).sum(1)
        least = entropy[np.arange(len(texts)), best]
        found = [self.languages[i] if k else UNKNOWN for i, k in zip(best, letters)]
        rejected = np.array([x != UNKNOWN and e > self.limit.get(x, np.inf) for x, e in zip(found, least)], bool)
        return found, np.where(letters > 0, score, 0.0), least, rejected


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of each language, summed within a batch."""
    for batch in batches:
        by: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for some in slices(texts):
                codes, *_ = letters_of(some)
                key, n = np.unique(keys_of(codes)[_within(codes)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )


def build(counts: pd.DataFrame) -> Model:
    languages = sorted(counts["lang"].unique())
    # One alphabet for all, and one place in it for every unseen character: else a language with few would win those.
    size = len(np.unique(counts["gram"].to_numpy().view(np.uint64) & U64((1 << 16) - 1))) + 1
    orders: list[list[tuple]] = [[] for _ in range(ORDER)]
    floor = []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        key = own["gram"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        layers = [(key[order], own["n"].to_numpy()[order].astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):  # below the top, how many different characters precede
            layers.append(tuple(np.unique(layers[-1][0] & U64((1 << 16 * n) - 1), return_counts=True)))
        lower = None
        made = []
        for n, (k, c) in zip(range(1, ORDER + 1), reversed(layers)):
            made.append(_kneser_ney(k, c.astype(np.float64), n, lower, size))
            lower = made[-1][3]
        for depth, layer in enumerate(reversed(made)):
            orders[depth].append(layer)
        floor.append(0.0 - np.log(size))
    model = Model(languages, floor=np.array(floor, np.float32))
    for layers in orders:
        union = np.unique(np.concatenate([x[0] for x in layers]))
        model.grams.append(HashArray(union, np.stack([np.log(x[3](union)) for x in layers], 1)))
        contexts = np.unique(np.concatenate([x[1] for x in layers]))
        weights = np.zeros((len(contexts), len(layers)))
        for i, x in enumerate(layers):
            weights[np.searchsorted(contexts, x[1]), i] = np.log(x[2])
        model.backs.append(HashArray(contexts, weights))
    return model


def train(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    known = texts_of(docs, F.col("lang").cast("string").alias("lang"), held_out().alias("_out")).where(
        F.col("lang").isNotNull() & ~F.col("_out") & F.col("doc_id").isNotNull()
    )
    least = F.min(F.when(F.col("text").rlike(r"\p{L}"), F.xxhash64("doc_id"))).alias("least")
    sizes = known.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"), least).collect()  # a row a language
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, sample_chars / max(1, r.chars))))])
    # Few long texts may all miss their share: the text with the least hash is always in.
    first = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(r.least).cast("long"))])
    pick = (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) | F.coalesce(
        F.xxhash64("doc_id") == first[F.col("lang")], F.lit(False)
    )
    sample = keep(known.where(pick).select("text", "lang"), "language-sample")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # n-grams of the bounded sample
    if not len(rows):
        return None
    model = build(rows)
    judged = sample.mapInArrow(
        _predict(docs.sparkSession.sparkContext.broadcast(model)), "lang string, lang_pred string, score double, entropy double, rejected boolean"
    )
    limits = judged.where("lang = lang_pred").groupBy("lang").agg(F.percentile_approx("entropy", 0.999, 10_000).alias("e"))
    model.limit = {r.lang: float(r.e) for r in limits.collect()}
    return model


def _predict(model) -> Callable:
    """The first column is the text; the others stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang_pred", "score", "entropy", "rejected"]
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            for some in slices(texts):
                lang, score, entropy, rejected = model.value.predict(some)
                new = [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)]
                old = [c.slice(at, len(some)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*old, *new], names=[*batch.schema.names[1:], *names])
                at += len(some)

    return run


def identify(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy (nats a character) and rejected of every row."""
    model = train(docs, sample_chars)
    rows = texts_of(docs, held_out().alias("held_out")).select("text", "doc_id", "held_out")
    if model is None:
        return rows.selectExpr(
            "doc_id", "held_out", f"'{UNKNOWN}' AS lang_pred", "0D AS score", "0D AS entropy", "false AS rejected"
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bounded by the sample
    return rows.mapInArrow(
        _predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean"
    )


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
