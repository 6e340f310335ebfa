"""Prefix tree of conversations, built as Z-fast tries.

A conversation is a string of turns, each turn 16 bytes (md5 of role and text). Strings are dealt to tasks by ranges of
their order, so that a task holds a contiguous part of the tree, whatever prefix many of them share. In each task a
Z-fast trie takes them in batches: compacted nodes are hashed by their handle, the prefix whose length is the two-fattest
number on the node's edge; a fat binary search over handles finds where a conversation leaves the trie in a
logarithmic number of lookups; its edge is split there. At the end edges are expanded to one node a turn.

Nodes on the path of a range's bound may also stand in other tasks. The bounds are put into the tries, so such nodes
are known; tasks give partial sums for them, which a last step over these few nodes (two paths a range) joins up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import keep, partitions
from haulmark.llm.merkle import CRC32

KEY = 16  # bytes of a turn
TASK_TURNS = 200_000  # a range is meant to hold about as many turns
SAMPLED = 16  # conversations looked at for each bound between ranges
ROWS, CHUNK = 10_000, 50_000  # rows handed on at a time, ids of one node written in one row


def turn_key(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def sequences(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: its turns in order as (key, chars). Texts are hashed where they are read and not moved.

    Null turn numbers come first; turns with the same number are ordered by their key. A null role or text is empty.
    Rows without a conv_id belong to no conversation and are left out. Other columns are not read. The hashes of one
    conversation (about 40 bytes a turn) must fit one task; its text need not.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), F.char_length(text).alias("chars")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "key", "chars")))
    short = F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars")))
    return turns.groupBy("conv_id").agg(short.alias("turns"))


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the greatest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Text:
    """A conversation in the trie: turns, their lengths, and a hash of each prefix."""

    __slots__ = ("chars", "marks", "path")

    def __init__(self, path: bytes, chars: list[int]):
        self.path, self.chars = path, chars
        self.marks = [b""]
        for at in range(0, len(path), KEY):
            self.marks.append(hashlib.blake2b(self.marks[-1] + path[at : at + KEY], digest_size=16).digest())

    def __len__(self) -> int:
        return len(self.marks) - 1

    def turn(self, depth: int) -> bytes:
        """The turn behind the first ``depth``."""
        return self.path[depth * KEY : (depth + 1) * KEY]


class Node:
    """A compacted node: the first ``depth`` turns of ``text``; its edge begins behind ``up.depth``."""

    __slots__ = ("below", "depth", "ends", "kids", "least", "leaves", "n", "outer", "saved", "text", "up")

    def __init__(self, text: Text, depth: int, up: Node | None):
        self.text, self.depth, self.up = text, depth, up
        self.kids: dict[bytes, Node] = {}
        self.ends: list[int] = []
        self.outer = False


class ZFastTrie:
    def __init__(self):
        self.root = Node(Text(b"", []), 0, None)
        self.nodes = [self.root]
        self.handles: dict[bytes, Node] = {}

    def _handle(self, node: Node) -> bytes:
        return node.text.marks[two_fattest(node.up.depth, node.depth)]

    def exit(self, text: Text) -> tuple[Node, Node | None]:
        """The deepest node that is a prefix of ``text``, and the node on whose edge it leaves the trie, if any."""
        node, low, high = self.root, 0, len(text)
        while low < high:
            at = two_fattest(low, high)
            found = self.handles.get(text.marks[at])
            if found is None:
                high = at - 1
            elif found.depth <= len(text) and found.text.marks[found.depth] == text.marks[found.depth]:
                node, low = found, found.depth
            else:
                return found.up, found
        return node, node.kids.get(text.turn(node.depth)) if node.depth < len(text) else None

    def insert(self, text: Text) -> Node:
        """The node at the end of ``text``, made if there is none."""
        node, edge = self.exit(text)
        if edge is not None:
            low, high = node.depth, min(edge.depth, len(text))
            while low < high:  # the longest common prefix
                at = (low + high + 1) // 2
                low, high = (at, high) if edge.text.marks[at] == text.marks[at] else (low, at - 1)
            node = self._split(edge, low)
        return node if node.depth == len(text) else self._add(Node(text, len(text), node))

    def _split(self, edge: Node, depth: int) -> Node:
        del self.handles[self._handle(edge)]
        middle = Node(edge.text, depth, edge.up)
        middle.outer = edge.outer
        edge.up = self._add(middle)
        middle.kids[edge.text.turn(depth)] = edge
        self.handles[self._handle(edge)] = edge
        return middle

    def _add(self, node: Node) -> Node:
        node.up.kids[node.text.turn(node.up.depth)] = node
        self.handles[self._handle(node)] = node
        self.nodes.append(node)
        return node

    def mark_outer(self, text: Text) -> None:
        """Nodes on the path of ``text`` may stand in other tries too."""
        node = self.insert(text)
        while node is not None:
            node.outer = True
            node = node.up


INSIDE, BELOW_OUTER, OUTER, ENDS = range(4)
COLUMNS = pa.schema(
    [
        ("kind", pa.int32()), ("part", pa.int32()), ("mark", pa.binary()), ("up", pa.binary()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.string()),
    ]
)
DDL = (
    "kind int, part int, mark binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved_tokens long, chars long, ends string"
)


def joined_ids(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


NO_ENDS = digest("")


def expand(trie: ZFastTrie, part: int) -> Iterator[tuple]:
    """A row per turn of every edge, deepest nodes first, so that sums below a node are there when it comes."""
    for node in sorted(trie.nodes, key=lambda x: -x.depth):
        kids = [k for k in node.kids.values() if k.n]
        node.n = len(node.ends) + sum(k.n for k in kids)
        if not node.n:
            continue  # a bound that no conversation of this range follows
        node.least = min([*node.ends[:1], *(k.least for k in kids)])
        text, first = node.text, node.up.depth + 1 if node.up else 0
        own = [k for k in kids if not k.outer]
        if node.outer:
            sums = len(own), sum(k.leaves for k in own), sum(k.saved for k in own)
            for d in range(node.depth, first - 1, -1):
                up = text.marks[d - 1] if d else None
                yield OUTER, part, text.marks[d], up, node.least, d, None, node.n, *sums, text.chars[d - 1] if d else 0, None
                sums = 0, 0, 0
            for at in range(0, len(node.ends), CHUNK):
                some = node.ends[at : at + CHUNK]
                yield ENDS, part, text.marks[node.depth], None, some[0], node.depth, *[None] * 6, joined_ids(some)
            continue
        node.leaves = sum(k.leaves for k in own) or 1
        node.saved = sum(k.saved for k in own)
        below, ends = len(own), digest(joined_ids(node.ends))
        for d in range(node.depth, first - 1, -1):
            node.saved += (node.n - 1) * text.chars[d - 1]
            # Along an edge the members are the same; the parent of its first node is known when that has its sums.
            kind = BELOW_OUTER if d == first and node.up.outer else INSIDE
            row = kind, part, text.marks[d], text.marks[d - 1], node.least, d, node.least, node.n, below, node.leaves, node.saved
            below = 1
            if d == first and kind == INSIDE:
                node.below = (*row, ends)
            else:
                yield *row, None, ends
            ends = NO_ENDS
        for kid in own:
            *row, kid_ends = kid.below
            row[6] = node.least
            yield *row, None, kid_ends


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    run: list[tuple] = []
    for row in rows:
        run.append(row)
        if len(run) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run), schema)], schema=schema)
            run = []
    if run:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run), schema)], schema=schema)


def grow(stream: Iterator[pa.RecordBatch], bounds: list[tuple[bytes, int, list[int]]]) -> Iterator[tuple]:
    """Tries of the ranges in a task, one behind the other; rows come by (part, conv_id)."""
    trie, part = None, None
    for batch in stream:
        for number, conv, path, chars in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if number != part:
                if trie is not None:
                    yield from expand(trie, part)
                trie, part = ZFastTrie(), number
                trie.root.outer = True
                for path_of, _, chars_of in bounds[max(0, part - 1) : part + 1]:
                    trie.mark_outer(Text(path_of, chars_of))
            trie.insert(Text(path, chars)).ends.append(conv)
    if trie is not None:
        yield from expand(trie, part)


def _bounds(rows: DataFrame, parts: int, conversations: int) -> list[tuple[bytes, int, list[int]]]:
    """Conversations that part the order of all into ranges of about the same number; from a sample bounded by ``parts``."""
    if parts < 2 or not conversations:
        return []
    share = min(1.0, SAMPLED * parts / conversations)
    drawn = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    seen = sorted((bytes(r.path), r.conv_id, list(r.chars)) for r in drawn.limit(2 * SAMPLED * parts).collect())
    return [seen[len(seen) * i // parts] for i in range(1, parts)] if len(seen) >= parts else seen[1:]


def _finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the nodes on bounds, from the deepest up; there are two paths a range."""
    nodes = [r for batch in stream for r in batch.to_pylist()]
    nodes.sort(key=lambda r: -r["depth"])
    at = {r["mark"]: r for r in nodes}
    rows = []
    for r in nodes:
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        up = at.get(r["up"]) if r["depth"] else None
        if up is not None:
            up["n_children"] += 1
            for name in ("n_leaves", "saved_tokens"):
                up[name] += r[name]
    for r in nodes:
        r |= {"kind": OUTER, "part": None, "parent_conv_id": at[r["up"]]["conv_id"] if r["depth"] else None, "ends": None}
        rows.append(tuple(r[name] for name in COLUMNS.names))
    yield from batches(rows, COLUMNS)


def _hash_ends(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, read piece by piece in order."""
    schema = pa.schema([("mark", pa.binary()), ("ends_sha256", pa.string())])

    def rows() -> Iterator[tuple]:
        node, state = None, None
        for batch in stream:
            for mark, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if mark != node:
                    if state is not None:
                        yield node, state.hexdigest()
                    node, state = mark, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
        if state is not None:
            yield node, state.hexdigest()

    yield from batches(rows(), schema)


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """Every node of the prefix tree of (conv_id, turns), each conv_id once.

    ``mark`` names a node and ``up`` its parent; ``conv_id`` is the smallest member. Sums cover the node's subtree.
    An empty table has no nodes; a conversation without turns is a member of the root.
    """
    rows = keep(
        sequences.select(
            "conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.chars").alias("chars")
        ),
        "trie-paths",
    )
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("chars")), F.lit(0)).alias("turns")).first()
    parts = max(1, min(size.n, max(partitions(rows), -(-size.turns // TASK_TURNS))))
    bounds = _bounds(rows, parts, size.n)
    marks = [(path, conv) for path, conv, _ in bounds]

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            where = [bisect_right(marks, x) for x in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), batch["conv_id"], batch["path"], batch["chars"]], ["part", "conv_id", "path", "chars"]
            )

    dealt = rows.mapInArrow(deal, "part int, conv_id long, path binary, chars array<int>")
    ranges = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "conv_id")
    made = keep(ranges.mapInArrow(lambda stream: batches(grow(stream, bounds), COLUMNS), DDL), "trie-nodes")

    outer = made.where(F.col("kind") == OUTER)
    merged = outer.groupBy("mark").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.min(name).alias(name) for name in ("up", "depth", "chars")],
    )
    tops = keep(merged.coalesce(1).mapInArrow(_finish, DDL), "trie-tops")
    pieces = made.where(F.col("kind") == ENDS).select("mark", "conv_id", "ends")
    hashed = pieces.repartition("mark").sortWithinPartitions("mark", "conv_id").mapInArrow(_hash_ends, "mark binary, ends_sha256 string")

    columns = ["mark", "up", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inside = made.where(F.col("kind") == INSIDE).select(*columns, F.col("ends").alias("ends_sha256"))
    # A range looks up its own nodes on bounds, so the many children of one such node are spread as the ranges are.
    known = outer.select("part", F.col("mark").alias("up")).join(
        tops.select(F.col("mark").alias("up"), F.col("conv_id").alias("_parent")), "up"
    )
    below = (
        made.where(F.col("kind") == BELOW_OUTER)
        .join(known, ["part", "up"])
        .withColumn("parent_conv_id", F.col("_parent"))
        .select(*columns, F.col("ends").alias("ends_sha256"))
    )
    top = tops.select(*columns).join(hashed, "mark", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return inside.unionByName(below).unionByName(top)


BLOCK, KINDS = 100, 6


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Each conversation with its first turns replaced by those of the first conversation of its hundred.

    As many as crc32 of its id modulo 6: at most five short rows a conversation are joined, and at most a hundred
    conversations share them.
    """
    own = keep(sequences(conversations), "trie-sequences")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % KINDS
    shared = own.where(F.col("conv_id") % BLOCK == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, KINDS - 1).alias("shared")
    )
    joined = own.select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), head.cast("int").alias("head")
    ).join(shared, "base", "left")
    first = F.coalesce(F.expr("slice(shared, 1, head)"), F.expr("slice(turns, 1, 0)"))
    return joined.select("conv_id", F.concat(first, F.expr("slice(turns, head + 1, size(turns))")).alias("turns"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return prefix_nodes(rebuilt(conversations)).drop("mark", "up")


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, strlen(role) || ':' || role || strlen(text) || ':' || text AS said, length(text) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS no
  FROM turns
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % {BLOCK} AS base, {CRC32.format(x='conv_id::VARCHAR')} % {KINDS} AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)
), parts AS (
  SELECT c, 0 AS own, no, said, chars FROM convs JOIN numbered ON conv_id = base AND no <= h
  UNION ALL
  SELECT c, 1, no, said, chars FROM convs JOIN numbered ON conv_id = c AND no > h
), ordered AS (
  SELECT c, said, chars, row_number() OVER (PARTITION BY c ORDER BY own, no) AS depth FROM parts
), prefixes AS (
  SELECT c, depth, chars, string_agg(said, '') OVER (PARTITION BY c ORDER BY depth) AS prefix FROM ordered
  UNION ALL
  SELECT c, 0, 0, '' FROM convs
), ends AS (
  SELECT c, max(depth) AS depth FROM prefixes GROUP BY c
), members AS (
  SELECT p.c, p.depth, p.chars, p.prefix, e.depth = p.depth AS ending,
         lag(p.prefix) OVER (PARTITION BY p.c ORDER BY p.depth) AS up
  FROM prefixes p JOIN ends e ON e.c = p.c
), nodes AS (
  SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, any_value(chars) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ending), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix
), children AS (
  SELECT up AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up, depth
), facts AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (prefix, depth)
), sums AS (
  SELECT m.depth, m.prefix, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum((f.n_convs - 1) * f.chars) AS saved_tokens
  FROM facts f JOIN members m ON m.c = f.conv_id AND m.depth <= f.depth GROUP BY m.depth, m.prefix
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s USING (depth, prefix) LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.prefix = f.up
"""
