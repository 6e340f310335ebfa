"""Merkle manifest of a data set: what was stored is proved, and what was changed is found.

Rows become leaves, runs of 16 nodes become their parent, first within each source and then over the sources. The
levels are stored as node rows that name their parent and hold the hashes left and right of them. A recursive query
then climbs from the leaves to the root; it appends the siblings of each step and folds the hashes to be checked.

The leaves of one run share every step above it, so a climbing row carries a run: one fold for the leaves that were
not changed, one for each that was. A row of the query is thus bounded by 16 folds and 15 siblings a level, however
large a source is, and the node rows are a fifteenth of the leaves.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.llm.common import keep, partitions

FAN = 16
TOP = -1  # the tree over the sources; each source is a tree with its own number
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ID = "struct<tree:bigint,level:int,place:bigint>"
_ROW = (1 << 33) - 1  # monotonically increasing ids: partition number above, row number in the lower 33 bits


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digits(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_hash(values: dict[str, Column]) -> Column:
    """Hash of a row: each value as its UTF-8 length, a colon and the value, or ``-`` where it is null."""
    parts = []
    for name in FIELDS:
        text = values.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return sha(F.concat(*parts))


def joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, digits), "")


@dataclass
class Manifest:
    """``runs``: the leaves, 16 to a row; ``nodes``: every node with a parent; ``root``: id and hash, None without rows."""

    runs: DataFrame
    nodes: DataFrame
    root: tuple[dict, str] | None


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows in a global order, kept with an id that grows along it; ``_part`` is the range a row fell into."""
    ordered = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    rows = keep(ordered.withColumn("_id", F.monotonically_increasing_id()), name)
    return rows.withColumn("_part", F.shiftright("_id", 33))


def leaves_of(docs: DataFrame, changed: Column | None) -> DataFrame:
    """Per row its source's number and size, its place there, its hash and, where ``changed`` is not null, that of
    the row with the changed text.

    Only hashes are moved. Places come from a range sort: a source of any size is spread over ranges, and what is
    gathered per source is a row for each range it touches.
    """
    other = F.when(changed.isNotNull(), leaf_hash({"text": changed})) if changed is not None else F.lit(None).cast("binary")
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # Null comes first, then the order of the bytes.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("src"),
        leaf_hash({}).alias("leaf"),
        other.alias("changed"),
    )
    rows = numbered(hashed, ["src", "doc_id", "leaf"], "merkle-leaves")
    pieces = rows.groupBy("_part", "src").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first"))
    whole = Window.partitionBy("src")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = keep(
        pieces.select(
            "_part", "src", "first", F.sum("n").over(whole).alias("size"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
        ),
        "merkle-pieces",
    )
    sources = numbered(pieces.select("src", "size").distinct(), ["src"], "merkle-sources")
    starts = sources.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = starts.select("_part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("start"))
    named = sources.join(starts, "_part").select("src", (F.col("start") + F.col("_id").bitwiseAND(_ROW)).alias("tree"))
    return rows.join(pieces.join(named, "src"), ["_part", "src"]).select(
        "tree", "size", (F.col("_id") - F.col("first") + F.col("before")).alias("place"), "doc_id", "leaf", "changed"
    )


def _ceil(n: str) -> Column:
    return F.expr(f"({n} + {FAN - 1}) div {FAN}")


def _id(tree: str | Column, level: Column, place: str | Column) -> Column:
    return F.struct(
        (F.col(tree) if isinstance(tree, str) else tree).alias("tree"), level.cast("int").alias("level"),
        (F.col(place) if isinstance(place, str) else place).alias("place"),
    ).cast(ID)


def _levels(level: DataFrame, most: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """The node rows of a forest from its lowest level up, and its tops.

    ``level`` has a row per node: id, tree, place, height, n (nodes of its tree on this level) and hash. ``most`` is
    the greatest n, so the number of levels is known and grows with its logarithm.
    """
    links, tops = [], []
    while True:
        tops.append(level.where("n = 1").select("tree", "id", "hash"))
        if most <= 1:
            return links, tops
        up = F.expr(f"place div {FAN}")
        groups = keep(
            level.where("n > 1")
            .groupBy("tree", up.alias("place"))
            .agg(
                F.sort_array(F.collect_list(F.struct("place", "id", "hash"))).alias("kids"),
                F.first("n").alias("n"), F.first("height").alias("height"),
            )
            .select("tree", "place", "kids", _ceil("n").alias("n"), (F.col("height") + 1).alias("height")),
            name,
        )
        parent = _id("tree", F.col("height"), "place")
        hashes = F.col("kids.hash")
        links.append(
            groups.select(parent.alias("parent"), "kids", F.posexplode("kids").alias("at", "kid")).select(
                "kid.id", "parent", "kid.hash",
                joined(F.slice(hashes, F.lit(1), F.col("at"))).alias("left"),
                joined(F.slice(hashes, F.col("at") + 2, F.lit(FAN))).alias("right"),
            )
        )
        level = groups.select(parent.alias("id"), "tree", "place", "height", "n", sha(joined(hashes)).alias("hash"))
        most = -(-most // FAN)


def build(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """Store the levels of ``docs``. ``changed`` is the text to be checked against the stored one, null where none is."""
    leaves = leaves_of(docs, changed)
    kids = F.sort_array(F.collect_list(F.struct("place", "doc_id", "leaf", "changed")))
    runs = keep(
        leaves.groupBy("tree", "size", F.expr(f"place div {FAN}").alias("place")).agg(kids.alias("leaves")), "merkle-runs"
    )
    lone = F.col("size") == 1  # a lone leaf is its own top
    hashes = F.col("leaves.leaf")
    height = F.when(lone, 0).otherwise(1)
    lowest = runs.select(
        _id("tree", height, "place").alias("id"), "tree", "place", height.alias("height"), _ceil("size").alias("n"),
        F.when(lone, hashes[0]).otherwise(sha(joined(hashes))).alias("hash"),
    )
    sizes = runs.agg(F.max("size").alias("size"), (F.max("tree") + 1).alias("sources")).first()
    if sizes.size is None:
        return Manifest(runs, _no_nodes(docs.sparkSession), None)
    links, tops = _levels(lowest, -(-sizes.size // FAN), "merkle-level")
    subroots = reduce(DataFrame.unionByName, tops).select(
        "id", F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(0).alias("height"),
        F.lit(sizes.sources).alias("n"), "hash",
    )
    upper, root = _levels(subroots, sizes.sources, "merkle-upper-level")
    nodes = reduce(DataFrame.unionByName, links + upper, _no_nodes(docs.sparkSession))
    top = reduce(DataFrame.unionByName, root).first()
    return Manifest(runs, keep(nodes, "merkle-nodes"), (top.id.asDict(), bytes(top.hash).hex()))


def _no_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"id {ID}, parent {ID}, hash binary, left string, right string")


CLIMB = """
WITH RECURSIVE climb(tree, place, at, folds, siblings, subroot) AS (
  SELECT tree, place, at, folds, CAST('' AS BINARY), CAST(NULL AS BINARY) FROM {runs}
  UNION ALL
  SELECT c.tree, c.place, n.parent,
         transform(c.folds, f -> unhex(sha2(concat(n.left, lower(hex(f)), n.right), 256))),
         concat(c.siblings, unhex(n.left), unhex(n.right)),
         coalesce(c.subroot, if(n.parent.tree = {top}, n.hash, null))
  FROM climb c JOIN {nodes} n ON n.id = c.at
)
SELECT tree, place, folds, siblings, subroot FROM climb WHERE at.tree = {tree} AND at.level = {level} AND at.place = {at}
"""


def climb(manifest: Manifest) -> DataFrame:
    """Per run of leaves: folds up to the root, the siblings above the run, and the source's top (null: the root itself)."""
    spark = manifest.runs.sparkSession
    hexed = "transform(leaves.leaf, h -> lower(hex(h)))"
    fold = F.expr(
        f"transform(filter(leaves, x -> x.changed is not null), x -> if(size = 1, x.changed, unhex(sha2(array_join("
        f"transform(leaves, y -> lower(hex(if(y.place = x.place, x.changed, y.leaf)))), ''), 256))))"
    )
    own = F.expr(f"if(size = 1, leaves[0].leaf, unhex(sha2(array_join({hexed}, ''), 256)))")
    start = manifest.runs.select(
        "tree", "place", _id("tree", F.when(F.col("size") == 1, 0).otherwise(1), "place").alias("at"),
        F.concat(F.array(own), fold).alias("folds"),
    )
    names = {"runs": f"runs_{uuid.uuid4().hex}", "nodes": f"nodes_{uuid.uuid4().hex}"}
    start.createOrReplaceTempView(names["runs"])
    manifest.nodes.createOrReplaceTempView(names["nodes"])
    limit = "spark.sql.cteRecursionRowLimit"
    had = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # rows grow with the leaves; the levels end the recursion
    try:
        root = manifest.root[0]
        sql = CLIMB.format(**names, top=TOP, tree=root["tree"], level=root["level"], at=root["place"])
        return keep(spark.sql(sql), "merkle-climbed")
    finally:
        spark.conf.set(limit, had)
        for view in names.values():
            spark.catalog.dropTempView(view)


AUDIT = "doc_id long, leaf string, subroot string, root string, siblings string, folded_root string, verified boolean"


def audit(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Proof of every row, and whether the text to be checked still folds to the root.

    ``siblings`` are the hashes beside the row's path from its run up to the root, left to right. Null values have a
    mark of their own, so null and empty text differ; equal ids are ordered by their hash, and equal rows are leaves
    each. Null sources are one source and null ids come first in theirs. An empty table gives no rows. Columns other
    than ``FIELDS`` are not read. A text of any length is hashed in one piece and not moved.
    """
    manifest = build(docs, changed)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], AUDIT)
    rows = manifest.runs.join(climb(manifest), ["tree", "place"])
    changed_places = F.expr("transform(filter(leaves, x -> x.changed is not null), x -> x.place)")
    one = rows.select(
        "leaves", "folds", "siblings", "subroot", changed_places.alias("changed_places"), F.explode("leaves").alias("x")
    )
    beside = F.expr("array_join(transform(filter(leaves, y -> y.place <> x.place), y -> lower(hex(y.leaf))), '')")
    root = F.lit(manifest.root[1])
    folded = F.expr("folds[array_position(changed_places, if(x.changed is null, -1, x.place))]")
    return one.select(
        "x.doc_id", digits(F.col("x.leaf")).alias("leaf"), F.coalesce(digits(F.col("subroot")), root).alias("subroot"),
        root.alias("root"), F.concat(beside, digits(F.col("siblings"))).alias("siblings"),
        digits(folded).alias("folded_root"), (digits(folded) == root).alias("verified"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    picked = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    found = audit(docs, F.when(picked, lowered))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified"
    )


# CRC-32 (polynomial 0xEDB88320, reflected) of the ASCII text in column {x}.
CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),"
    " lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),"
    " lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
)

_FIELD = "coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(x=x) for x in FIELDS[:-1])
_LOWER = f"translate(text, '{UPPER}', '{LOWER}')"

ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, sha256({_HEAD} || {_FIELD.format(x='text')}) AS leaf,
         CASE WHEN {CRC32.format(x='doc_id::VARCHAR')} % 5 = 0
              THEN sha256({_HEAD} || {_FIELD.format(x=_LOWER)}) END AS changed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), low AS (
  SELECT 0 AS height, src, place, leaf AS h, count(*) OVER (PARTITION BY src) AS n FROM placed
  UNION ALL
  SELECT height, src, place, h, count(*) OVER (PARTITION BY src) AS n FROM (
    SELECT any_value(height) + 1 AS height, src, place // {FAN} AS place, sha256(string_agg(h, '' ORDER BY place)) AS h
    FROM low WHERE n > 1 GROUP BY src, place // {FAN})
), subroots AS (
  SELECT src, h, height, row_number() OVER (ORDER BY src) - 1 AS no FROM low WHERE n = 1
), high AS (
  SELECT 0 AS height, no AS place, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT height, place, h, count(*) OVER () AS n FROM (
    SELECT any_value(height) + 1 AS height, place // {FAN} AS place, sha256(string_agg(h, '' ORDER BY place)) AS h
    FROM high WHERE n > 1 GROUP BY place // {FAN})
), nodes AS (
  SELECT src AS tree, height, place, h, n FROM low
  UNION ALL SELECT NULL, height, place, h, n FROM high
), steps AS (
  SELECT row_number() OVER () AS row, p.doc_id, p.src, p.src AS tree, 0 AS height, p.place, p.leaf,
         coalesce(p.changed, p.leaf) AS folded, '' AS proof, s.no, s.height AS last, false AS fin
  FROM placed p JOIN subroots s USING (src)
  UNION ALL
  SELECT row, doc_id, src, CASE WHEN up THEN NULL ELSE tree END, CASE WHEN up THEN 0 ELSE height + 1 END,
         CASE WHEN up THEN no ELSE place // {FAN} END, leaf, CASE WHEN up THEN folded ELSE sha256(parts) END,
         proof || coalesce(others, ''), no, last, fin
  FROM (
    SELECT c.row, any_value(c.doc_id) AS doc_id, any_value(c.src) AS src, any_value(c.tree) AS tree,
           any_value(c.height) AS height, any_value(c.place) AS place, any_value(c.leaf) AS leaf,
           any_value(c.folded) AS folded, any_value(c.proof) AS proof, any_value(c.no) AS no, any_value(c.last) AS last,
           c.tree IS NOT NULL AND any_value(c.height) = any_value(c.last) AS up,
           c.tree IS NULL AND any_value(n.n) = 1 AS fin,
           string_agg(CASE WHEN n.place = c.place THEN c.folded ELSE n.h END, '' ORDER BY n.place) AS parts,
           string_agg(n.h, '' ORDER BY n.place) FILTER (n.place <> c.place) AS others
    FROM steps c JOIN nodes n ON n.tree IS NOT DISTINCT FROM c.tree AND n.height = c.height
         AND n.place // {FAN} = c.place // {FAN}
    WHERE NOT c.fin AND NOT (c.tree IS NULL AND n.n = 1)
    GROUP BY c.row, c.tree)
), done AS (
  SELECT s.* FROM steps s WHERE tree IS NULL AND height = (SELECT max(height) FROM high)
)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.folded AS folded_root,
       d.folded = r.h AS verified
FROM done d JOIN subroots s ON s.src = d.src, (SELECT h FROM high WHERE n = 1) r
"""
