"""The manifest against a plain recursive one."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from haulmark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree long, place string, `a.b` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root of the nodes, and for each its siblings of every level."""
    paths, owner = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_owner = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k, members in enumerate(owner[at : at + 16]):
                for i in members:
                    paths[i].append((run[:k], run[k + 1 :]))
            up.append(sha("".join(run)))
            up_owner.append(sum(owner[at : at + 16], []))
        nodes, owner = up, up_owner
    return nodes[0], paths


def brute(rows, changed):
    by = {}
    for r in rows:
        by.setdefault("" if r["source"] is None else "=" + r["source"], []).append(r)
    tops, inner = [], {}
    for src in sorted(by, key=str.encode):
        group = sorted(by[src], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        top, paths = climb([leaf(r, r["text"]) for r in group])
        tops.append(top)
        inner[src] = group, paths
    root, upper = climb(tops)
    out = []
    for no, src in enumerate(inner):
        for r, path in zip(*inner[src]):
            steps = path + upper[no]
            fold = leaf(r, changed(r))
            for before, after in steps:
                fold = sha("".join([*before, fold, *after]))
            siblings = "".join(h for step in steps for part in step for h in part)
            out.append((r["doc_id"], leaf(r, r["text"]), tops[no], root, siblings, fold, fold == root))
    return out


def tampered(r):
    if r["text"] is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5:
        return r["text"]
    return r["text"].translate({ord(c): c.lower() for c in merkle.UPPER})


def audited(docs):
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.audit(docs, F.when(picked, F.translate("text", merkle.UPPER, merkle.LOWER)))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, n, 7, "p", 1) for i, t, lang, src, n in rows], SCHEMA)


TABLES = {
    "lone": [(5, "Only One", "en", "s", 8)],
    "one source": [(i, f"Text {i}", "en", "s", i) for i in range(300)],
    "lone leaves of many sources": [(i, f"Text {i}", None, f"s{i:03d}", None) for i in range(40)],
    "odd": [(i % 90, f"É {i % 45} A", None if i % 3 else "fr", [None, "", "hot", "hot", "=é", "z"][i % 6], -i % 45) for i in range(700)]
    + [(None, None, None, None, None)] * 2 + [(None, "", None, "hot", 0), (3, "L" * 300_000, "de", "hot", 1), (17, None, "de", "last", 1)],
}


@pytest.mark.parametrize("name", TABLES)
def test_manifest_equals_a_plain_one(spark, name):
    docs = table(spark, TABLES[name])
    rows = [r.asDict() for r in docs.collect()]
    want = sorted(map(str, brute(rows, tampered)))
    got = sorted(str(tuple(r)) for r in audited(docs.repartition(5)).collect())
    assert got == want


def test_empty_table(spark):
    assert audited(table(spark, [])).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    found = merkle.op13_merkle_manifest(spark, folder)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet')")
    want = con.sql(merkle.ORACLE)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000"
