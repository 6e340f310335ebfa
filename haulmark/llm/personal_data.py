"""Personal data: addresses and numbers by pattern, and the terms that give them away by corpus co-occurrence.

An entity is a distinct e-mail address, IP address, card or phone number. Its context is the ``WINDOW`` terms on either
side of it. A term t discloses an entity e by the share of e's information that it carries,

    D(t, e) = PMI(t; e) / IC(e) = log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

with N documents, n(t) of them holding t, n(e) having e in a context of its own and n(t, e) with t in that context:
1 says that t stands only where e does, 0 that they are independent. Equal contexts of an entity count once, so copies
of a document are no evidence. Terms in at least ``SUPPORT`` documents with D >= ``THRESHOLD`` are spans of kind
``term`` wherever they stand in a context of their entity. They are generalised to their first ``GENERAL`` letters if
these disclose less than the threshold, else removed.

Co-occurrence is gathered from contexts only; n(t) is counted over all documents for the terms that need it. A bitmap
of fixed size tells which may: a term more costs a few rows and nothing else.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import keep, texts_of

KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL, IP, CARD, PHONE, TERM = range(5)
WINDOW, SUPPORT, THRESHOLD, GENERAL = 8, 3, 0.8, 3
BITS = 20  # of the bitmap that tells which terms to count

# --- Fixed values: the patterns and bounds of the base kinds. -----------------------------
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
CALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, OCTET = (14, 19), (10, 15), 255

_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")
_OTHER = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every e-mail address, IP address, card and phone number, in linear time."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            found.append((start, EMAIL, done))
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in DOTTED.finditer(text):
            parts = m[0].split(".") if m.end() - m.start() > 6 else ()
            start = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= OCTET for p in four):
                    found.append((start, IP, end))
                start = end + 1
        for m in DIGITS.finditer(text):
            if m.end() - m.start() >= CARD_DIGITS[0]:
                digits = m[0].translate(_OTHER)
                if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
                    found.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in CALLED.finditer(text):
            if PHONE_DIGITS[0] <= len(m[0].translate(_OTHER)) <= PHONE_DIGITS[1]:
                found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> bytes:
    """The same for other spellings of an address or number."""
    value = value.lower() if kind == EMAIL else value if kind == IP else "".join(c for c in value if c.isdigit())
    return hashlib.md5(f"{kind}:{value}".encode()).digest()


def terms_of(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]


def contexts(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[bytes, bytes, list[tuple[int, int, str]]]]:
    """For each base span its entity, a hash of its context and the terms there; parts of base spans are no terms."""
    outside, i = [], 0
    ends: list[int] = []
    for start, _, end in spans:  # how far the spans up to here reach
        ends.append(max(end, ends[-1] if ends else 0))
    starts = [s for s, _, _ in spans]
    for term in terms_of(text):
        while i < len(spans) and ends[i] <= term[0]:
            i += 1
        if i == len(spans) or starts[i] >= term[1]:
            outside.append(term)
    firsts = [t[0] for t in outside]
    for start, kind, end in spans:
        left, right = bisect_left(firsts, start), bisect_left(firsts, end)
        near = outside[max(0, left - WINDOW) : left], outside[right : right + WINDOW]
        seen = "|".join(" ".join(t[2] for t in side) for side in near)
        yield entity(kind, text[start:end]), hashlib.md5(seen.encode()).digest(), near[0] + near[1]


def row_key(doc_id: int | None, text: str) -> bytes:
    return hashlib.md5(f"{'-' if doc_id is None else doc_id}:{text}".encode()).digest()


def key_column() -> Column:
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(named, F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))))


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct(
    [("entity", pa.binary()), ("context", pa.binary()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
)
_FOUND = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("base", pa.list_(_SPAN)), ("seen", pa.list_(_SEEN))])
FOUND = (
    "doc_id long, key binary, base array<struct<start:int,kind:int,end:int>>,"
    " seen array<struct<entity:binary,context:binary,term:string,start:int,end:int>>"
)


def _find(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _SPAN.names
    for batch in stream:
        keys, base, seen = [], [], []
        docs = batch.column(0).to_pylist()
        for doc, text in zip(docs, batch.column(1)):
            text = text.as_py()
            spans = base_spans(text)
            base.append([dict(zip(names, s)) for s in spans])
            keys.append(row_key(doc, text) if spans else None)
            seen.append(
                [
                    {"entity": e, "context": c, "term": t, "start": start, "end": end}
                    for e, c, near in contexts(text, spans)
                    for start, end, t in near
                ]
                if spans
                else []
            )
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs, keys, base, seen), _FOUND)], schema=_FOUND)


def base_found(docs: DataFrame) -> DataFrame:
    """One row per document, kept: base spans, and the terms near them. ``key`` (id and text) is null without spans."""
    return keep(texts_of(docs).mapInArrow(_find, FOUND), "personal-found")


def general(term: str) -> str:
    return term[:GENERAL] + "*"


def _counts(stream: Iterator[pa.RecordBatch], wanted: bytes) -> Iterator[pa.RecordBatch]:
    """Documents per wanted term and beginning of a term; counts add up over the rows given out."""
    schema = pa.schema([("feature", pa.string()), ("n", pa.int64())])
    counts: Counter = Counter()
    known: dict[str, tuple[str, ...]] = {}

    def features(term: str) -> tuple[str, ...]:
        both = (term, general(term))
        bits = [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in both]
        return tuple(x for x, b in zip(both, bits) if wanted[b >> 3] >> (b & 7) & 1)

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)
        counts.clear()
        return rows

    for batch in stream:
        for text in batch.column(0):
            held: set[str] = set()
            for term in set(_TERM.findall(text.as_py())):
                have = known.get(term)
                if have is None:
                    if len(known) > 200_000:
                        known.clear()
                    have = known[term] = features(term.lower())
                held.update(have)
            counts.update(held)
        if len(counts) > 200_000:
            yield flush()
    if counts:
        yield flush()


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, general) of the terms that disclose too much; ``general`` is null where they are removed.

    Every step is a keyed count; an entity or a term of any frequency is counted before it is moved.
    """
    spark = docs.sparkSession
    seen = found.where(F.size("seen") > 0).select("key", F.explode("seen").alias("x")).select("key", "x.entity", "x.context", "x.term")
    one = seen.groupBy("entity", "context").agg(F.min("key").alias("doc"))
    of_entity = one.groupBy("entity", "doc").agg(F.lit(1)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    stem = F.concat(F.substring("term", 1, GENERAL), F.lit("*"))
    both = seen.select("key", "entity", "context", F.explode(F.array("term", stem)).alias("feature"))
    once = both.groupBy("entity", "feature", "context").agg(F.min("key").alias("doc"))
    pairs = once.groupBy("entity", "feature", "doc").agg(F.lit(1)).groupBy("entity", "feature").agg(F.count(F.lit(1)).alias("n_te"))
    pairs = keep(pairs.where(F.col("n_te") >= SUPPORT), "personal-pairs")

    place = F.crc32(F.col("feature").cast("binary")).bitwiseAND((1 << BITS) - 1)
    bits = bytearray(1 << BITS - 3)
    for row in pairs.select(place.alias("place")).distinct().toLocalIterator():  # at most 2**BITS rows
        bits[row.place >> 3] |= 1 << (row.place & 7)
    if not any(bits):
        return spark.createDataFrame([], "entity binary, term string, general string")
    wanted = bytes(bits)
    texts = texts_of(docs).select("text")
    counted = texts.mapInArrow(lambda stream: _counts(stream, wanted), "feature string, n long")
    of_term = keep(counted.groupBy("feature").agg(F.sum("n").alias("n_t")), "personal-terms")

    n = F.lit(float(found.count()))
    rated = pairs.join(keep(of_entity, "personal-entities"), "entity").join(of_term, "feature")
    share = F.try_divide(F.log(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))), F.log(n / F.col("n_e")))
    high = keep(rated.where(share >= THRESHOLD).select("entity", "feature"), "personal-high")
    stems = high.where(F.col("feature").endswith("*")).select("entity", F.col("feature").alias("stem"), F.lit(True).alias("told"))
    terms = high.where(~F.col("feature").endswith("*")).select("entity", F.col("feature").alias("term"))
    with_stem = terms.withColumn("stem", stem).join(stems, ["entity", "stem"], "left")
    keeps = F.col("told").isNull() & (F.char_length("term") > GENERAL)
    return keep(with_stem.select("entity", "term", F.when(keeps, F.col("stem")).alias("general")), "personal-disclosures")


def term_spans(found: DataFrame, told: DataFrame) -> DataFrame:
    """Per ``key`` the spans of disclosing terms, as (start, kind, end, general)."""
    seen = found.where(F.size("seen") > 0).select("key", F.explode("seen").alias("x"))
    hits = seen.select("key", "x.entity", "x.term", "x.start", "x.end").join(told, ["entity", "term"])
    # A term near two entities is removed if either asks for it.
    spans = hits.groupBy("key", "start", "end").agg(F.max(F.col("general").isNull()).alias("gone"), F.max("general").alias("general"))
    span = F.struct("start", F.lit(TERM).alias("kind"), "end", F.expr("if(gone, null, general)").alias("general"))
    return keep(spans.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("terms")), "personal-spans")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, ``key``, ``base`` and ``terms`` (null without any).

    A null text is empty. Rows with the same id and text count as one document in the statistics and get the same
    spans; a null id is an id of its own. Columns but doc_id and text are not read. Texts of any length are searched
    whole in linear time. An empty table gives no rows.
    """
    found = base_found(docs)
    spans = term_spans(found, disclosures(docs, found))
    bare = found.drop("seen")
    with_base = bare.where("key is not null").join(spans, "key", "left")
    none = bare.where("key is null").withColumn("terms", F.lit(None).cast(spans.schema["terms"].dataType))
    return with_base.unionByName(none)


MASKS = [f"[{kind.upper()}]" for kind in KINDS[:TERM]]


def masked(text: str, base: list, terms: list) -> str:
    """The text with each span replaced: base ones by their kind, terms by their beginning or by nothing.

    Spans that overlap are replaced as one, by the first.
    """
    spans = [(s["start"], s["end"], MASKS[s["kind"]]) for s in base] + [(s["start"], s["end"], s["general"] or "") for s in terms]
    out, at = [], 0
    for start, end, mask in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, with personal data masked in the text; a null text stays null."""
    spans = personal_data(docs).where("key is not null").dropDuplicates(["key"]).select(F.col("key").alias("k"), "base", "terms")

    @F.pandas_udf("string")
    def mask(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
        rows = zip(text, base, terms)
        return pd.Series([t if b is None else masked(t, list(b), [] if x is None else list(x)) for t, b, x in rows], dtype=object)

    rows = docs.select(key_column().alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(spans, "k", "left")
    clean = F.when(F.col("base").isNotNull(), mask("row.text", "base", "terms")).otherwise(F.col("row.text"))
    return joined.select(F.col("row").withField("text", clean).alias("row")).select("row.*")


def op11_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{folder}/documents.parquet"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

    plain = F.transform(F.coalesce("terms", F.array()), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(TERM)]
    return found.select(
        "doc_id", *counts, F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("base", plain))).alias("spans"),
    )
