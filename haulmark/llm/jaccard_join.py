"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word n-grams. Sizes fall into bands such that two similar sets
lie in one band or in neighbouring ones. For a band, similar sets differ in at most k features. The feature domain is
cut by a hash into n1 = 1.25 (k + 1) partitions. Similar sets agree in full on at least n1 - k of them, so on some
partition they share its signature. Small sets cut every partition of n1 = (k + 1) / 2 into 3 parts and enumerate all
subsets of 2 parts instead, of which similar sets share at least one.

1. Equal sets collapse to a class, combined before the shuffle, so copies cost nothing from here on.
2. Classes with too few signatures that any other class has cannot have a partner, and leave. Signatures travel packed,
   with 32-bit hashes; clashes only let more classes stay.
3. The classes left are dealt into chunks of about ``CHUNK``: each goes with the leader (smallest class of a signature)
   that most of its signatures have, so near copies meet in one chunk, and larger crowds are cut.
4. A class visits another chunk only if enough of its signatures occur there. Each pair of chunks is one block, in
   which exact overlaps are counted by inverted lists; a block returns link counts and a spanning forest of its links,
   never its pairs.
5. Components of the forests are the result.

No link is lost: who has a partner shares enough signatures with it to stay and to visit its chunk, and all pairs of
a block are judged exactly.

Nulls: a null text is empty; empty sets link with nothing and are their own component. Fewer words than n make one
feature of the whole sequence. Repeated rows are copies: they link with each other. A null ``doc_id`` takes part in
links if an equal set has an id, and a component's id is the smallest one that is not null. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import (
    U64,
    WHITE,
    below,
    keep,
    mix,
    partitions,
    prefix_hash,
    releasing,
    releasing_group,
    runs_of,
    signed,
    span_hash,
    texts_of,
    utf8,
)
from haulmark.llm.components import components
from haulmark.llm.packed import as_batch, pack_by_bucket, packed_ddl, packed_schema, unpack

NUM, DEN = 90, 100
WORDS = 3
CHUNK = 2048
BUCKET_SIGNATURES = 2_000_000
ENTRIES = 500_000  # of the inverted lists, looked at in one go
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[list(WHITE)] = True


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of all texts one behind the other, and where each text's begin."""
    data, offsets = utf8(column)
    n_docs = len(offsets) - 1
    data = _LOWER[data]
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside & (cut[:-1] | ~np.r_[False, inside[:-1]])
    last = inside & (cut[1:] | ~np.r_[inside[1:], False])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    word = mix(span_hash(prefix_hash(data), start, end) ^ mix((end - start).astype(np.uint64), 5), 1)
    at = np.searchsorted(start, offsets)  # words before each text
    count = np.diff(at)
    doc = np.repeat(np.arange(n_docs), count)
    place = np.arange(len(word)) - at[doc]
    short = np.minimum(count, words)[doc]  # words of the feature that starts here
    starts = np.flatnonzero((place + short <= count[doc]) & ((count[doc] >= words) | (place == 0)))
    feature = np.zeros(len(starts), np.uint64)
    for i in range(words):
        there = starts[short[starts] > i]
        part = mix(word[there + i], 10 + i)
        feature[short[starts] > i] += part
    feature = mix(feature, 3) ^ mix(short[starts].astype(np.uint64), 4)
    owner = doc[starts]
    order = np.lexsort((feature, owner))
    feature, owner = feature[order], owner[order]
    new = np.r_[True, (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])][: len(feature)]
    feature, owner = feature[new], owner[new]
    return feature, np.searchsorted(owner, np.arange(n_docs + 1))


def bands(limit: int, num: int, den: int) -> np.ndarray:
    """Smallest size of each band up to the one behind that of ``limit``, with a further bound."""
    lows = [1]
    while len(lows) < 3 or lows[-3] <= limit:
        lows.append(lows[-1] * den // num + 1)
    return np.array(lows)


def shape(sizes: np.ndarray, instance: np.ndarray, lows: np.ndarray, num: int, den: int) -> tuple:
    """For sets in an instance: whether parts are enumerated, partitions, and the least signatures that partners share.

    Instance i serves the pairs of band i, and those of band i - 1 with band i.
    """
    k = 2 * (lows[instance + 1] - 1) * (den - num) // (den + num)  # most differences of a similar pair
    few = (k > 0) & (k < 16)
    n1 = np.where(few, (k + 2) // 2, np.where(k > 0, (k + 1) * 5 // 4, 1))
    return few, n1, np.where(few, 1, n1 - k)


def signatures(feature: np.ndarray, offsets: np.ndarray, num: int = NUM, den: int = DEN) -> Iterator[tuple]:
    """(set, signature) of all sets that are not empty: in the instance of their band, then in the next one."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    lows = bands(int(sizes.max(initial=1)), num, den)
    band = np.searchsorted(lows, sizes, "right") - 1
    h = mix(feature, 21)
    part_hash, sub, value = mix(h, 22), below(mix(h, 23), 3), mix(h, 24)
    for instance in (band, band + 1):
        few, n1, _ = shape(sizes, instance, lows, num, den)
        width = np.where(few, 3, 1)
        base = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(np.where(sizes > 0, n1 * width, 0), out=base[1:])
        part = below(part_hash, n1[owner])
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, base[owner] + part * width[owner] + np.where(few[owner], sub, 0), value)
        cell_owner = np.repeat(np.arange(len(sizes)), np.diff(base))
        cell = np.arange(base[-1]) - base[cell_owner]
        left = np.flatnonzero(few[cell_owner])
        if len(left):  # of three parts, the subset without part j is the sum of the other two
            trio = total[left].reshape(-1, 3)
            total[left] = (trio.sum(1, dtype=np.uint64)[:, None] - trio).ravel()
        name = mix(instance[cell_owner].astype(np.uint64), 31)
        yield cell_owner, mix(mix(total, 32) ^ name ^ mix(cell.astype(np.uint64), 33), 34)


def _digests(feature: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums that name a set."""
    out = []
    for salt in (41, 42):
        run = np.r_[U64(0), np.cumsum(mix(feature, salt), dtype=np.uint64)]
        out.append(run[offsets[1:]] - run[offsets[:-1]])
    return out[0], out[1]


def _describe(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s, e in runs_of(whole.column(1)):
                batch = whole.slice(s, e - s)
                feature, offsets = shingle_sets(batch.column(1), words)
                one, two = _digests(feature, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(offsets)), pa.array(signed(one)), pa.array(signed(two))],
                    names=["doc_id", "n_shingles", "one", "two"],
                )

    return run


def _deal(words: int, num: int, den: int, buckets: int) -> Callable:
    """Packed signatures of the sets a task meets for the first time, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple] = set()
        for whole in batches:
            for s, e in runs_of(whole.column(0)):
                feature, offsets = shingle_sets(whole.column(0).slice(s, e - s), words)
                one, two = _digests(feature, offsets)
                fresh = np.array([x not in told and not told.add(x) for x in zip(one.tolist(), two.tolist())], bool)
                if len(told) > 500_000:
                    told.clear()
                who, sig, role = [], [], []
                for r, (owner, found) in enumerate(signatures(feature, offsets, num, den)):
                    say = fresh[owner]
                    who.append(owner[say])
                    sig.append(found[say])
                    role.append(np.full(int(say.sum()), r, np.uint8))
                who, sig, role = np.concatenate(who), np.concatenate(sig), np.concatenate(role)
                values = {"sig": (sig & U64(0xFFFFFFFF)).astype("<u4"), "role": role}
                yield as_batch(pack_by_bucket(below(sig, buckets), who, signed(one), signed(two), values), packed_schema("sig", "role"))

    return run


def _common(frame: pd.DataFrame) -> pd.DataFrame:
    """How many signatures of each class, in either instance, another class has too."""
    one, two, sig, role = unpack(frame, {"sig": "<u4", "role": "<u1"})
    order = np.argsort(sig, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(sig[order]) != 0][: len(sig)])
    if not len(cut):
        return pd.DataFrame({"one": [], "two": [], "own": [], "next": []}, dtype=np.int64)
    shared = np.minimum.reduceat(one[order], cut) != np.maximum.reduceat(one[order], cut)
    hit = order[np.repeat(shared, np.diff(np.r_[cut, len(sig)]))]
    found = pd.DataFrame({"one": one[hit], "two": two[hit], "own": role[hit] == 0, "next": role[hit] == 1})
    return found.groupby(["one", "two"], as_index=False)[["own", "next"]].sum().astype(np.int64)


def _may_link(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own, next_ = (batch.column(c).to_numpy() for c in ("n", "own", "next"))
            lows = bands(int(sizes.max(initial=1)), num, den)
            band = np.searchsorted(lows, sizes, "right") - 1
            stay = (own >= shape(sizes, band, lows, num, den)[2]) | (next_ >= shape(sizes, band + 1, lows, num, den)[2])
            yield batch.filter(pa.array(stay))

    return run


def _sign(num: int, den: int) -> Callable:
    """Class, signature, instance (own 0, next 1) and how many of them partners share there, of stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                raw = batch.column(1).to_pylist()
                offsets = np.cumsum([0, *(len(x) // 8 for x in raw)])
                sizes, one = np.diff(offsets), batch.column(0).to_numpy()
                lows = bands(int(sizes.max(initial=1)), num, den)
                band = np.searchsorted(lows, sizes, "right") - 1
                found = signatures(np.frombuffer(b"".join(raw), np.uint64), offsets, num, den)
                for role, (owner, sig) in enumerate(found):
                    need = shape(sizes, band + role, lows, num, den)[2]
                    columns = [one[owner], signed(sig), np.full(len(owner), role), need[owner]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "sig", "role", "need"])

    return run


def _own_sets(words: int) -> Callable:
    """The set of each class. A leader's id may stand on other rows too: only the class's own set counts, and once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple] = set()
        for whole in batches:
            for s, e in runs_of(whole.column(0)):
                batch = whole.slice(s, e - s)
                feature, offsets = shingle_sets(batch.column(0), words)
                one, two = (signed(x).tolist() for x in _digests(feature, offsets))
                names = list(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()))
                own = [a == b and not (a in given or given.add(a)) for a, b in zip(names, zip(one, two))]
                raw = feature.tobytes()
                found = pa.array([raw[8 * s : 8 * e] for s, e in zip(offsets, offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[1:], found], names=[*batch.schema.names[1:], "features"]
                ).filter(pa.array(own, pa.bool_()))

    return run


class Inverted:
    """Which sets have each feature that more than one set has."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values = values[order]
        same = values[1:] == values[:-1]
        del values
        again = np.r_[False, same][: len(order)]
        shared = again | np.r_[same, False][: len(order)]
        order, first = order[shared], np.flatnonzero(~again[shared])
        self.begin = np.r_[first, len(order)]
        self.members = np.searchsorted(np.cumsum([len(x) for x in sets]), order, "right")
        back = np.argsort(order)  # set by set
        self.owner = self.members[back]
        self.column = np.repeat(np.arange(len(first)), np.diff(self.begin))[back]
        self.first = np.searchsorted(self.owner, np.arange(self.n + 1))

    def overlaps(self, start: int, stop: int) -> np.ndarray:
        """Sizes of the intersections of the sets from start to stop with all sets."""
        mine = slice(self.first[start], self.first[stop])
        column, row = self.column[mine], self.owner[mine] - start
        length = self.begin[column + 1] - self.begin[column]
        total = np.cumsum(length)
        out = np.zeros((stop - start) * self.n, np.int64)
        done = 0
        while done < len(column):
            end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + ENTRIES, "right")))
            k = length[done:end]
            at = np.arange(k.sum()) + np.repeat(self.begin[column[done:end]] - (np.cumsum(k) - k), k)
            out += np.bincount(np.repeat(row[done:end] * self.n, k) + self.members[at], minlength=len(out))
            done = end
        return out.reshape(stop - start, self.n)


def _judge(num: int, den: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links of one block: per class the weight of its partners, and a spanning forest."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["n", "leader"], ignore_index=True)
        sets = [np.frombuffer(b, np.uint64) for b in block["features"]]
        ids, weight, chunk = block["leader"].to_numpy(), block["copies"].to_numpy(), block["chunk"].to_numpy()
        sizes = block["n"].to_numpy()
        i_side, j_side = int(block["i"].iat[0]), int(block["j"].iat[0])
        partners = np.zeros(len(sets), np.int64)
        root = np.arange(len(sets))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        lists = Inverted(sets)
        for at in range(0, len(sets), 64):
            left = range(at, min(at + 64, len(sets)))
            stop = int(np.searchsorted(sizes, sizes[left[-1]] * den // num, "right"))
            right = range(at, max(stop, left[-1] + 1))
            common = lists.overlaps(left.start, left.stop)[:, right.start : right.stop]
            union = sizes[left.start : left.stop, None] + sizes[None, right.start : right.stop] - common
            link = (den * common >= num * union) & (np.arange(len(right))[None, :] > np.arange(len(left))[:, None])
            if i_side != j_side:
                link &= chunk[left.start : left.stop, None] != chunk[None, right.start : right.stop]
            a, b = np.nonzero(link)
            np.add.at(partners, a + at, weight[b + at])
            np.add.at(partners, b + at, weight[a + at])
            for x, y in zip((a + at).tolist(), (b + at).tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        tops = np.array([find(x) for x in range(len(sets))], np.int64)
        return pd.DataFrame({"a": ids, "b": ids[tops] if len(ids) else ids, "partners": partners})

    return run


def jaccard_groups(
    docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row; linked: den * intersection >= num * union."""
    given = texts_of(docs)
    described = keep(
        given.mapInArrow(releasing(_describe(words)), "doc_id long, n_shingles long, one long, two long"), "jaccard-sets"
    )
    classes = keep(
        described.where("n_shingles > 0")
        .groupBy("one", "two")
        .agg(F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n")),
        "jaccard-classes",
    )
    load = (classes.agg(F.sum("n")).first()[0] or 0) * 3 * (den - num) // den
    buckets = max(partitions(docs), -(-load // BUCKET_SIGNATURES))
    shared = (
        given.select("text")
        .mapInArrow(releasing(_deal(words, num, den, buckets)), packed_ddl("sig", "role"))
        .groupBy("bucket")
        .applyInPandas(releasing_group(_common), "one long, two long, own long, next long")
        .groupBy("one", "two")
        .agg(F.sum("own").alias("own"), F.sum("next").alias("next"))
    )
    columns = "leader long, copies long, n long, one long, two long, own long, next long"
    left = keep(
        classes.join(shared, ["one", "two"])
        .select(*[c.split()[0] for c in columns.split(", ")])
        .mapInArrow(releasing(_may_link(num, den)), columns)
        .drop("own", "next"),
        "jaccard-left",
    )
    sets = keep(
        given.withColumnRenamed("doc_id", "leader")
        .join(left.hint("merge"), "leader")
        .select("text", "leader", "copies", "n", "one", "two")
        .mapInArrow(releasing(_own_sets(words)), "leader long, copies long, n long, one long, two long, features binary"),
        "jaccard-features",
    )
    # The first half of a set's name stands for it here; a clash only makes it visit more blocks.
    bucket = Window.partitionBy("sig")
    signed_rows = sets.select("one", "features").mapInArrow(releasing(_sign(num, den)), "a long, sig long, role long, need long")
    rows = keep(
        signed_rows.withColumns({"leader": F.min("a").over(bucket), "most": F.max("a").over(bucket)})
        .where("leader <> most")
        .drop("most"),
        "jaccard-signatures",
    )
    home = (
        rows.groupBy("a", "leader")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("a")
        .agg(F.max(F.struct("n", "leader")).alias("top"))
        .select("a", F.xxhash64("top.leader").alias("home"))
    )
    crowd = home.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    bins = -(-sets.count() // chunk)
    cut = F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / chunk))
    placed = keep(
        home.join(crowd, "home").select(
            "a",
            F.when(F.col("size") <= chunk, F.pmod("home", F.lit(max(1, bins))))
            .otherwise(bins + F.pmod(F.xxhash64("home", cut), F.lit(1 << 40)))
            .alias("chunk"),
        ),
        "jaccard-chunks",
    )
    there = rows.select("a", "sig", "role", "need").join(placed.hint("merge"), "a")
    held = there.groupBy("sig", F.col("chunk").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    visits = (
        there.join(held.hint("merge"), "sig")
        .where("chunk <> other or n > 1")
        .groupBy("a", "chunk", "other", "role")
        .agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
        .where("n >= need")
        .select(F.col("a").alias("one"), "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        .distinct()
    )
    blocks = (
        sets.join(visits.hint("merge"), "one")
        .select("leader", "copies", "n", "chunk", "features", "i", "j")
        .repartition(partitions(docs), "i", "j")
    )
    judged = keep(
        blocks.groupBy("i", "j").applyInPandas(releasing_group(_judge(num, den)), "a long, b long, partners long"),
        "jaccard-links",
    )
    linked = components(judged.select("a", "b")).select(F.col("node").alias("leader"), "component")
    partners = judged.groupBy(F.col("a").alias("leader")).agg(F.sum("partners").alias("partners"))
    named = keep(
        classes.join(linked, "leader", "left")
        .join(partners, "leader", "left")
        .select(
            "one",
            "two",
            F.coalesce("component", "leader").alias("component_id"),
            (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "jaccard-named",
    )
    filled = described.where("n_shingles > 0").select("doc_id", "n_shingles", "one", "two")
    return (
        filled.join(named, ["one", "two"])
        .select("doc_id", "n_shingles", "component_id", "n_links")
        .unionByName(
            described.where("n_shingles = 0").select(
                "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
            )
        )
    )


def keep_leaders(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows whose id is that of their group, with their columns. Rows without words are no group, and stay."""
    first = jaccard_groups(docs, words, num, den).where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    own = "component" + "_" * (1 + max(map(len, docs.columns)))  # longer than any name of the documents
    return docs.join(first.withColumnRenamed("doc_id", own), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Links of distinct sets by inverted lists, then closure.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
         WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
         END AS sh
  FROM w
), f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT x, y FROM o UNION ALL SELECT y, x FROM o),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, len(s.sh) AS n_shingles,
       least(s.doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = s.doc_id), s.doc_id)) AS component_id,
       (SELECT count(*) FROM e WHERE e.x = s.doc_id) AS n_links
FROM s
"""
