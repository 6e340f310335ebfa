"""SimHash fingerprints of 128 bits and their search by permuted block tables, in DataFrame operations only.

Terms are pairs of neighbouring words (a lone word is its own term), hashed to 128 bits. Every occurrence votes on each
bit with the length of its words, up to ``HEAVIEST``, so frequent terms weigh by their frequency and short function
words weigh little. Votes are summed two bits at a time in the halves of a long.

Search: within a radius of r bits, two fingerprints agree on at least one of r + 1 blocks. All fingerprints are entered
once per block under the block's value; a query looks its own blocks up, measures the candidates' distance, and counts
each at the first block the two share. Equal fingerprints are entered once with their number.

Nulls: a null text is empty, and an empty text has the fingerprint of zeros. A null ``doc_id`` comes behind all others.
Rows with equal ids follow each other by a hash of their texts. Repeated rows give repeated results; a single row is
its own next document; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import keep, partitions, texts_of

HEAVIEST = 32
RADIUS = 3
QUERY_STEP = 20
_LAST = (1 << 63) - 1
_PAIR = (1 << 32) | 1


def terms(text: Column) -> Column:
    """(hash, weight) of the terms of a text."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    weight = lambda *w: F.least(sum(F.char_length(x) for x in w), F.lit(HEAVIEST)).cast("long")
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("h"), weight(a, b).alias("w"))
    lone = F.transform(words, lambda a: F.struct(F.xxhash64(a).alias("h"), weight(a).alias("w")))
    both = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), pair)
    return F.when(F.size(words) > 1, both).otherwise(lone)


def votes(h: Column, w: Column, name: str) -> list[Column]:
    """Sums of the weights of terms that have bit j (lower half) and bit j + 32 (upper half), for j = 0 ... 31."""
    return [F.sum(w * F.shiftright(h, j).bitwiseAND(_PAIR)).alias(f"{name}{j}") for j in range(32)]


def word_of(name: str) -> Column:
    """64 bits from the votes: set where more than half of the weight has it."""
    bits = []
    for j in range(32):
        low = F.col(f"{name}{j}").bitwiseAND((1 << 32) - 1)
        high = F.shiftrightunsigned(F.col(f"{name}{j}"), 32)
        bits += [(low, j), (high, j + 32)]
    parts = [F.when(2 * v > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0)) for v, j in bits]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def fingerprinted(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per distinct ``keys`` with its fingerprint ``a``, ``b``; the keys must name a text."""
    exploded = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("t"))
    second = F.xxhash64(F.col("t.h"), F.lit(1))
    sums = exploded.groupBy(*keys).agg(
        F.sum("t.w").alias("weight"), *votes(F.col("t.h"), F.col("t.w"), "x"), *votes(second, F.col("t.w"), "y")
    )
    return sums.select(*keys, word_of("x").alias("a"), word_of("y").alias("b"))


def hex_of(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    return 1 - (F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))) / F.lit(128.0)


def blocks(radius: int) -> list[Column]:
    """128 bits cut into radius + 1 blocks, each moved to the low end of a long."""
    size = 128 // (radius + 1)
    if 64 % size or size > 64:
        raise ValueError("128 bits must fall into radius + 1 blocks that do not cross a word: radius 1, 3, 7 or 15")
    mask = (1 << size) - 1 if size < 64 else -1
    return [F.shiftrightunsigned(F.col(w), s).bitwiseAND(mask) for w in ("a", "b") for s in range(0, 64, size)]


def neighbours(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b of each distinct query, and how many rows of ``fingerprints`` lie within the radius."""
    cells = F.posexplode(F.array(*blocks(radius)))
    table = fingerprints.groupBy("a", "b").agg(F.count(F.lit(1)).alias("rows")).select("a", "b", "rows", cells.alias("block", "cell"))
    asked = queries.select("a", "b").distinct().select(F.col("a").alias("qa"), F.col("b").alias("qb"), cells.alias("block", "cell"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("qa"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("qb")))
    size = 128 // (radius + 1)
    mask = (1 << size) - 1 if size < 64 else -1
    differs = [
        F.shiftrightunsigned(F.col(w).bitwiseXOR(F.col(f"q{w}")), s).bitwiseAND(mask) != 0
        for w in ("a", "b")
        for s in range(0, 64, size)
    ]
    first = reduce(lambda x, y: x & y, [(F.col("block") <= i) | d for i, d in enumerate(differs)])
    return (
        table.join(asked, ["block", "cell"])
        .where((distance <= radius) & first)
        .groupBy(F.col("qa").alias("a"), F.col("qb").alias("b"))
        .agg(F.sum("rows").alias("n_near"))
    )


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with the next one's text and key, ascending; behind the last comes the first.

    Rows are dealt into ranges of ids. The first row of each range is also put behind the last of the range before.
    """
    keyed = texts_of(docs).select(
        "doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("print"), "text"
    )
    n = 4 * partitions(docs)
    marks = F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)
    bounds = sorted(set(texts_of(docs).agg(marks.alias("m")).first().m or []))  # 4 * shuffle partitions at most
    bound = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(bound, lambda b: b < F.col("doc"))) if bounds else F.lit(0)
    placed = keyed.withColumn("bucket", bucket).withColumn("guest", F.lit(False))
    heads = placed.groupBy("bucket").agg(F.min(F.struct("doc", "print")).alias("head"))  # a row a range
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    hosts = heads.select("head.doc", "head.print", before.alias("host"))
    guests = (
        placed.drop("bucket", "guest")
        .join(F.broadcast(hosts), ["doc", "print"])
        .select("doc_id", "doc", "print", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    )
    rows = Window.partitionBy("bucket").orderBy("guest", "doc", "print")
    return (
        placed.unionByName(guests)
        .select(
            "doc_id",
            "doc",
            "print",
            "text",
            "bucket",
            "guest",
            F.row_number().over(rows).alias("place"),
            F.lead("text").over(rows).alias("next_text"),
            F.lead("doc").over(rows).alias("next_doc"),
            F.lead("print").over(rows).alias("next_print"),
        )
        .where("not guest")
        .drop("guest")
    )


def fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row.

    ``n_near``: for ids divisible by ``QUERY_STEP``, how many rows (itself included) lie within the radius; else null.
    """
    n = F.char_length("text")
    rows = with_next(docs).withColumns(
        {
            "n_chars": n.cast("long"),
            "edited": F.concat(
                F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")),
                F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int")),
            ),
        }
    )
    keys = ["bucket", "place", "doc_id", "doc", "print", "next_doc", "next_print", "n_chars", "edited_sha256"]
    versions = F.explode(F.array(*[F.struct(F.lit(e).alias("edited"), F.col(c).alias("text")) for e, c in ((False, "text"), (True, "edited"))]))
    both = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, versions.alias("v"))
    made = keep(
        fingerprinted(both.select(*keys, "v.edited", "v.text"), "text", *keys, "edited"), "fingerprints"
    )
    plain = made.where("not edited").drop("edited")
    edited = made.where("edited").select("bucket", "place", F.col("a").alias("c"), F.col("b").alias("d"))
    following = plain.groupBy(F.col("doc").alias("next_doc"), F.col("print").alias("next_print")).agg(
        F.min("a").alias("e"), F.min("b").alias("f")
    )
    near = neighbours(plain, plain.where(F.pmod("doc_id", F.lit(QUERY_STEP)) == 0), radius)
    col = F.col
    return (
        plain.join(edited, ["bucket", "place"])
        .join(following, ["next_doc", "next_print"])
        .join(near, ["a", "b"], "left")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            hex_of(col("a"), col("b")).alias("fingerprint"),
            hex_of(col("c"), col("d")).alias("edited_fingerprint"),
            likeness(col("a"), col("b"), col("c"), col("d")).alias("near_edited"),
            likeness(col("a"), col("b"), col("e"), col("f")).alias("near_next"),
            F.when(F.pmod("doc_id", F.lit(QUERY_STEP)) == 0, col("n_near")).alias("n_near"),
        )
    )


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
