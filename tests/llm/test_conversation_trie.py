"""The prefix tree against one made of all prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from haulmark.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, mark string, `a.b` int, path int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def md5(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in convs.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = {c: c - (abs(c) % 100) * (1 if c >= 0 else -1) for c in own}
    made = {c: tuple(own.get(base[c], [])[: head[c]] + own[c][head[c] :]) for c in own}
    members = {}
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members.setdefault(made[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (
            str((
                m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                hashlib.sha256(",".join(str(c) for c in m if made[c] == p).encode()).hexdigest(),
            ))
            for p, m in members.items()
        )
    )


def random_rows(seed, n, longest, words, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if c < hot:
            turns = ["hot", "hotter", "hottest"]
        else:
            turns = [rng.choice(words) for _ in range(rng.randint(1, longest))]
        rows += [(c * 7 % 1009, i, "user" if i % 2 else "bot", t) for i, t in enumerate(turns)]
    return rows


TABLES = {
    "few words": random_rows(1, 400, 9, ["a", "b", "é"], hot=150),
    "copies only": random_rows(2, 300, 5, ["x"]),
    "long": random_rows(3, 40, 300, ["u", "v"]) + [(2000, i, "user", "u" if i % 3 else "v") for i in range(4000)],
    "odd": [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "same turn"), (1, 0, "user", "same turn"), (None, 1, "user", "nobody"),
        (100, 0, "user", "base"), (101, 0, "user", "own"), (101, 9, None, "later"), (199, 3, "bot", "x" * 200_000), (-5, 0, "user", "minus"),
        (-105, 0, "user", "minus"), (7, 0, "us", "er:x"), (8, 0, "user", ":x"), (300, 0, "user", None),
    ],
    "one": [(4, 0, "user", "hi")],
}


@pytest.mark.parametrize("name", TABLES)
def test_tree_equals_all_prefixes(spark, name):
    rows = TABLES[name]
    found = trie.prefix_nodes(trie.rebuilt(table(spark, rows).repartition(3))).drop("mark", "up")
    assert sorted(str(tuple(r)) for r in found.collect()) == brute(rows)


def test_more_ranges_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "TASK_TURNS", 40)
    monkeypatch.setattr(trie, "CHUNK", 7)
    test_tree_equals_all_prefixes(spark, "few words")


def test_empty_table(spark):
    assert trie.prefix_nodes(trie.rebuilt(table(spark, []))).count() == 0


def test_two_fattest():
    for low in range(70):
        for high in range(low + 1, 70):
            want = max(range(low + 1, high + 1), key=lambda x: x & -x)
            assert trie.two_fattest(low, high) == want


def test_exit_nodes():
    rng = random.Random(5)
    turns = [bytes([i]) * trie.KEY for i in range(3)]
    for _ in range(30):
        made = trie.ZFastTrie()
        texts = [trie.Text(b"".join(rng.choice(turns) for _ in range(rng.randint(0, 40))), [1] * 40) for _ in range(60)]
        for text in texts[:40]:
            assert made.insert(text).depth == len(text)
        assert len(made.handles) == len(made.nodes) - 1
        for text in texts:
            node, edge = made.exit(text)
            assert text.path.startswith(node.text.path[: node.depth * trie.KEY])
            deeper = [x for x in made.nodes if x.depth <= len(text) and text.path.startswith(x.text.path[: x.depth * trie.KEY])]
            assert node is max(deeper, key=lambda x: x.depth)
            assert (edge is None) == (len(text) == node.depth or text.turn(node.depth) not in node.kids)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    found = trie.op12_conversation_trie(spark, folder)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet')")
    want = con.sql(trie.ORACLE)
    assert found.columns == want.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want.fetchall()))
