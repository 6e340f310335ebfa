"""Every operator against a brute-force version, on odd small inputs and on one of the given tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from haulmark.llm import (
    components,
    exact_dedup,
    fingerprints,
    jaccard_join,
    language,
    line_dedup,
    packing,
    piece_tokens,
    suffix_dedup,
    token_blocks,
    toxicity,
)
from haulmark.llm.byte_tokens import byte_level, tokenizer, word_level
from haulmark.llm.packed import unpack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, place string, _text string"
LONG = " ".join(f"Word{i % 97}x{i}" for i in range(3000))
PASSAGE = "a passage that several documents share, more than fifty bytes long, with é and ß in it. "
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one two",
    "One two\n",
    "café naïve  double  spaces",
    "the quick brown fox jumps over the lazy dog\nshared line of text\nlast",
    "other\n  SHARED line of text \nshared line of text\nend",
    "the quick brown fox jumps over the lazy dog\nshared line of text\nlast",
    PASSAGE + "begins here " + PASSAGE,
    "starts otherwise " + PASSAGE[10:] + "and ends otherwise",
    "x" * 300,
    "y" + "x" * 120,
    LONG,
    LONG.replace("Word5x5", "changed"),
    LONG.replace("Word7x7 ", "").replace("Word9x9", "else"),
    "日本語のテキスト。🙂 emoji",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", -1, 7, "p", "clash") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, "s", -1, 7, "p", "clash"), (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "documents"])
def table(request):
    return request.getfixturevalue(request.param)


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, *map(str, r)))


def test_exact_dedup(table):
    groups: dict[str, list] = {}
    for doc, text in pairs(table):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc is None, doc or 0, doc))
    want = []
    for bare, rows in groups.items():
        keep = min(rows)[3]
        want += [(r[3], keep, len(rows), hashlib.sha256(bare.encode()).hexdigest()) for r in rows]
    got = exact_dedup.exact_dedup(table)
    assert by_id(got.select("doc_id", "keep_id", "group_size", "text_sha256").collect()) == by_id(want)
    assert got.where("kept").count() == len(groups)
    kept = exact_dedup.keep_one(table)
    assert kept.columns == table.columns and kept.count() == len(groups)


def test_directory_splits_only_overfull_buckets():
    counts = {i: 1 for i in range(16)} | {0: 40}
    slots = exact_dedup.directory(counts, 4, 4)
    assert [p for p, _, _ in slots] == list(range(16))
    depths = {b: d for _, b, d in slots}
    load = {}
    for p, b, _ in slots:
        load[b] = load.get(b, 0) + counts[p]
    assert all(n <= 4 or depths[b] == 4 for b, n in load.items())
    assert exact_dedup.directory({}, 4, 4) == [(0, 0, 0)]


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "num", "den", "chunk"), [(3, 90, 100, 2048), (5, 80, 100, 3)])
def test_jaccard(table, words, num, den, chunk):
    known = table.where("doc_id is not null and not (doc_id = 3 and text is null)").dropDuplicates(["doc_id"])
    sets = {}
    for doc, text in pairs(known):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])
    ]
    root = closure(ids, links)
    degree = {i: sum(i in e for e in links) for i in ids}
    want = [(i, len(sets[i]), root[i], degree[i]) for i in ids]
    got = jaccard_join.jaccard_groups(known, words, num, den, chunk)
    assert by_id(got.select("doc_id", "n_shingles", "component_id", "n_links").collect()) == by_id(want)


def test_similar_sets_share_enough_signatures():
    rng = np.random.default_rng(1)
    for n in (3, 9, 12, 40, 150, 700):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for change in range(0, n // 9 + 1):
            other = base.copy()
            other[:change] = rng.integers(0, 2**63, change, dtype=np.uint64)
            if 100 * (n - change) < 80 * (n + change):
                continue
            feature = np.concatenate([np.sort(base), np.sort(other)])
            offsets = np.array([0, n, 2 * n])
            lows = jaccard_join.bands(n, 80, 100)
            band = np.searchsorted(lows, [n, n], "right") - 1
            owner, sig = next(iter(jaccard_join.signatures(feature, offsets, 80, 100)))
            need = jaccard_join.shape(np.array([n, n]), band, lows, 80, 100)[2][0]
            assert len(set(sig[owner == 0]) & set(sig[owner == 1])) >= need


def test_stages_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, `a.b` string, __component string, c0 int, row struct<doc_id:int>"
    docs = spark.createDataFrame([(i, t, "x", "y", i, (i,)) for i, t in enumerate(["one two", "one  two", PASSAGE, "more " + PASSAGE])], schema)
    for stage, n in ((exact_dedup.keep_one, 3), (jaccard_join.keep_leaders, 2), (suffix_dedup.without_repeats, 4)):
        rows = stage(docs).collect()
        assert stage(docs).columns == docs.columns and len(rows) == n
        assert all((r["a.b"], r["__component"], r.c0, r.row.doc_id) == ("x", "y", r.doc_id, r.doc_id) for r in rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 5), (5, 3), (9, 9)]
    got = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {i: 100 for i in range(100, 161)} | {1: 1, 5: 1, 3: 1}


def test_line_dedup(table):
    rows = pairs(table)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first: dict[str, float] = {}
    for doc, text in rows:
        for line in text.split("\n"):
            first[key(line)] = min(first.get(key(line), np.inf), np.inf if doc is None else doc)
    want = []
    for doc, text in rows:
        lines = text.split("\n")
        left = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (np.inf if doc is None else doc)]
        want.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    got = line_dedup.dedup_lines(table).select("doc_id", "n_lines", "n_dropped", "kept")
    assert by_id(got.collect()) == by_id(want)


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"the line that all share\nown line number {i}\nthe line that all share") for i in range(500)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {i: 2 * (i > 0) for i in range(500)}


def test_suffix_dedup(table):
    rows = sorted(((np.inf if d is None else d), i, d, t.encode()) for i, (d, t) in enumerate(pairs(table)))
    first: dict[bytes, float] = {}
    for rank, _, _, raw in rows:
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], rank)
    want = []
    for rank, _, doc, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < rank:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        want.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    for whole in (True, False):
        got = suffix_dedup.remove_repeats(table, whole=whole)
        assert by_id(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == by_id(want)
    assert suffix_dedup.without_repeats(table).columns == table.columns


def test_suffix_dedup_of_repeats_in_one_document(spark):
    rng = np.random.default_rng(3)
    a, s, b, u, v = ("".join(rng.choice(list("abcdefghijklmnop "), n)) for n in (90, 120, 90, 90, 90))
    texts = [(1, a + s + b), (2, u + s + v + u + s + v), (3, "start " + u + s + v + u + s + v), (5, b[:20] + s), (5, v + s + a)]
    texts += [(None, v[:60] + s + u), (None, "x " + v[:60] + s + u + v[:60] + s + u), (7, "z" * 400), (8, "y" + "z" * 300 + "y")]
    documents = spark.createDataFrame([*texts, texts[1]], "doc_id long, text string")
    test_suffix_dedup(documents)


def test_suffix_dedup_of_a_hot_passage(spark):
    """A passage in all documents with other surroundings each, twice in some, over several runs of texts."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    hot, lead = word(150), word(70)
    texts = [(i, word(40) + hot + word(60) + (lead + hot if i % 5 == 0 else lead[30:])) for i in range(120)]
    documents = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    test_suffix_dedup(documents)
    kept = suffix_dedup.remove_repeats(documents).agg({"n_removed": "min"}).where("`min(n_removed)` = 0")
    assert kept.count() == 1


def test_a_hot_passage_is_settled_before_the_deal():
    """Of an anchor that all documents of a run have, few places are dealt out; the rest goes by part."""
    texts = [f"{i:05d} own start of it {i * 7919:09d} " + "the passage that all of these documents hold, " * 2 for i in range(500)]
    arrays = [pa.array(range(500), pa.int64()), pa.array(range(500), pa.int64()), pa.array(texts)]
    batch = pa.RecordBatch.from_arrays(arrays, names=["doc", "print", "text"])
    rows = [b.to_pandas() for b in suffix_dedup._deal(4)(iter([batch]))]
    dealt = pd.concat(rows)
    dealt = dealt[dealt["bucket"] < 4]
    _, _, h, *_ = unpack(dealt, {"hashes": "<u4", "left": "<u1", "right": "<u1"})
    assert np.unique(h, return_counts=True)[1].max() <= suffix_dedup.HOT


def test_later_joins_of_suffix_dedup_move_no_text(spark):
    rows = [(i, f"{i} the same words in all of the documents, long enough to be found again {i}") for i in range(40)]
    done = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc" in line]
    spans = [line for line in plan.splitlines() if "_gather_spans" in line]
    assert spans and len(moved) <= 3  # spans twice (a union's copy) and open contexts, none of them above a text
    assert "Bucketed: true" in plan


def test_suffix_sort_orders_and_confirms():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    at = np.sort(rng.integers(0, 3900, 600))
    segment = np.sort(rng.integers(0, 5, 600))
    suffixes = suffix_dedup.Suffixes(data)
    order, run = suffixes.runs(at, segment)
    keys = [(segment[i], data[at[i] : at[i] + 50].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert all((keys[i] == keys[i - 1]) == (run[i] == run[i - 1]) for i in range(1, len(keys)))


def test_packing(table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = sorted(
        zlib.crc32(np.array([*tokenizer(path).encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
        for _, t in pairs(table)
    )
    pieces = packing.pieces_of(table, path)
    rows = packing.plan(pieces).collect()
    ids: dict[tuple, list] = {}
    for r in pieces.collect():
        assert len(r.ids) == 4 * r.length
        ids.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for (_, n), parts in ids.items():
        assert sum(len(b) for _, b in parts) % (4 * n) == 0
    whole = [zlib.crc32(b"".join(b for _, b in sorted(p))) for (k, n), p in ids.items() if k != "3"]
    assert set(whole) <= set(want)
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(n for p in by.values() for _, n in p) == sum(r.length for r in pieces.collect())


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(3).integers(1, 257, 700)
    slots, k = packing.partition(sizes, 1024)
    sums = np.bincount(slots, sizes, k)
    assert sums.max() <= 1024 and sums.max() - sums.min() < 16 and k <= -(-sizes.sum() // 1024) + 1
    assert packing.partition(np.array([1024, 1024, 1]), 1024)[1] == 3


def test_tokens_equal_the_library():
    texts = [t or "" for t in TEXTS] + ["it's I'LL ''s", "a \n b", "tail ", "<|endoftext|>", "İ Σς ²x", "a\n\n b"]
    for name, made in (("byte_bpe_50k.json", byte_level), ("word_bpe_49k.json", word_level)):
        path = public_tokenizers.path(name)
        want = [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in made(path).encode(texts)] == want


def test_words_that_lower_to_marks_equal_the_library():
    rng = np.random.default_rng(11)
    pieces = ["İ", "GAZİ", "Sİ", "ß", "ŉ", "ǰ", "ΐ", "Ω", "ﬁ", "Å", "e\u0301", "a", "Don", ".", ",", ":", "!", "?", "'s", "-", " ", "\n", "1", "é", "日", "İstanbul"]
    texts = ["GAZİ.", "Sİ!", "İ:", "İ|", "İ", "bİ,cİ", "x.İ", "İ.İ", "İİ;"]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(20_000)]
    for name, made in (("byte_bpe_50k.json", byte_level), ("word_bpe_49k.json", word_level)):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        got = [np.frombuffer(b, "<u4").tolist() for b in made(path).encode(texts)]
        assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_strings_of_added_tokens_equal_the_library():
    texts = [f"one two{m}three  four" for m in ("<|endoftext|>", " <|endoftext|>\n", "<|ENDOFTEXT|>", "<|startoftext|>", "<|end oftext|>")]
    texts += ["<|endoftext|>", "<|endoftext|><|endoftext|>", "a <|endoftext|> b", "Plain text", ""]
    for name, made, added in (("byte_bpe_50k.json", byte_level, 50256), ("word_bpe_49k.json", word_level, 49407)):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in made(path).encode(texts)] == want
        assert sum(ids.count(added) for ids in want) == 6


def test_pieces_round_trip(table):
    model = piece_tokens.codec(public_tokenizers.path("piece_bpe_32k.model")).model
    want = []
    for doc, text in pairs(table):
        ids = model.encode(text, add_bos=True, add_eos=True)
        want.append((doc, np.array(ids, "<u4").tobytes().hex(), model.decode(ids)))
    got = [(r.doc_id, bytes(r.ids).hex(), r.decoded) for r in piece_tokens.piece_round_trip(table).collect()]
    assert by_id(got) == by_id(want)


def test_token_blocks(table):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = {}
    for doc, text in pairs(table):
        ids = [*tokenizer(path).encode(text, add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append(np.array(ids, "<u4").tobytes())
    files = token_blocks.write_blocks(table, block_ids=2000)
    got = sorted(token_blocks.read_blocks(files).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and bytes(r.ids) in want[r.doc_id]
        at += len(r.ids) // 4
    assert len(got) == table.count()
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def test_token_blocks_with_added_tokens(spark):
    docs = spark.createDataFrame([(1, "one<|endoftext|>two"), (2, "plain"), (3, "<|startoftext|>")], "doc_id long, text string")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: [*plain.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = token_blocks.read_blocks(token_blocks.write_blocks(docs)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want and max(want[1]) == 49407


def test_damaged_block_is_noticed():
    block = token_blocks.write_block([1], [5], np.arange(5, dtype="<u4").tobytes(), 10)
    assert token_blocks.read_block(block)[2] == np.arange(5, dtype="<u4").tobytes()
    with pytest.raises(ValueError, match="damaged"):
        token_blocks.read_block(block[:-1] + bytes([block[-1] ^ 1]))


def test_fingerprints(table):
    rows = sorted(((d is None, d or 0, t) for d, t in pairs(table)))
    got = fingerprints.fingerprints(table).collect()
    assert len(got) == len(rows)
    print_of: dict[str, set] = {}
    texts = {d: t for _, d, t in rows}
    for r in got:
        print_of.setdefault(texts[r.doc_id or 0] if r.doc_id is not None else "no id at all", set()).add(r.fingerprint)
    ids = [d for _, d, _ in rows]
    if len(set(ids)) == len(ids):
        assert all(len(p) == 1 for p in print_of.values())
        by = {r.doc_id: r for r in got}
        for i, (_, d, t) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][2]
            q = len(t) // 4
            edited = t[: len(t) - q] + following[:q]
            assert by[d].n_chars == len(t)
            assert by[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        bits = {d: int(r.fingerprint, 16) for d, r in by.items()}
        for d, r in by.items():
            near = sum((bits[d] ^ b).bit_count() <= fingerprints.RADIUS for b in bits.values())
            assert r.n_near == (near if d % 20 == 0 else None)
        assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95


def test_language_on_held_out_rows(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 100 and right > 0.97


def test_language_odd(odd, spark):
    known = spark.createDataFrame(
        [(i, t, lang) for i in range(40) for t, lang in (("the cat sat on the mat", "en"), ("el gato se sienta aquí", "es"))],
        "doc_id long, text string, lang string",
    )
    asked = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    rows = {(r.doc_id, r.lang_pred) for r in language.identify(known.unionByName(asked)).collect() if r.score == 0}
    assert {(0, "und"), (1, "und"), (2, "und")} <= rows
    assert {r.lang_pred for r in language.identify(asked).collect()} == {"und"}


def test_language_of_few_long_texts_is_learned(spark):
    texts = [(i, t * 50, lang) for i in range(20) for t, lang in (("the cat sat on the mat ", "en"), ("el gato se sienta ", "es"))]
    texts += [(i, "", "fr") for i in range(100, 120)] + [(120, "le chat est assis", "fr")]
    known = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert language.train(known, sample_chars=1).languages == ["en", "es", "fr"]


def test_language_of_one_and_two_letters():
    import pandas as pd

    counts = []
    for lang, texts in (("en", ["a cat sat at a tap", "i"]), ("ru", ["я и ты и он", "и"])):
        codes, *_ = language.letters_of(texts)
        key, n = np.unique(language.keys_of(codes)[language._within(codes)], return_counts=True)
        counts.append(pd.DataFrame({"lang": lang, "gram": key.view(np.int64), "n": n}))
    model = language.build(pd.concat(counts, ignore_index=True))
    assert model.predict(["я", "a", "он", "at", "и"])[0] == ["ru", "en", "ru", "en", "ru"]
    codes, start, end, _ = language.letters_of(["ab", "c", "", "d e"])
    assert model.entropies(codes, start, end)[1].tolist() == [3, 2, 0, 4]
    assert (language.keys_of(codes)[start + 1] >> np.uint64(32) == 0).all()  # nothing of the text before


def grams(texts_of):
    import pandas as pd

    counts = []
    for lang, texts in texts_of.items():
        codes, *_ = language.letters_of(texts)
        key, n = np.unique(language.keys_of(codes)[language._within(codes)], return_counts=True)
        counts.append(pd.DataFrame({"lang": lang, "gram": key.view(np.int64), "n": n}))
    return pd.concat(counts, ignore_index=True)


class PlainKneserNey:
    """The same model by dictionaries, one n-gram at a time."""

    def __init__(self, counts, size):
        self.size, self.layers = size, {4: counts}
        for n in (3, 2, 1):
            self.layers[n] = {}
            for key in self.layers[n + 1]:
                short = key % (1 << 16 * n)
                self.layers[n][short] = self.layers[n].get(short, 0) + 1

    def p(self, key, n=4):
        if n == 0:
            return 1 / self.size
        key %= 1 << 16 * n
        layer, below = self.layers[n], self.p(key, n - 1)
        ones, twos = (sum(c == k for c in layer.values()) for k in (1, 2))
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        same = {k: c for k, c in layer.items() if k >> 16 == key >> 16}
        if not same:
            return below
        return (max(0, layer.get(key, 0) - discount) * (key in layer) + discount * len(same) * below) / sum(same.values())


def test_kneser_ney_equals_a_plain_one_and_sums_to_one():
    counts = grams({"x": ["abracadabra abba cab", "a bad cab"], "y": ["deed dada ace", "bead"]})
    size = len({k % (1 << 16) for k in counts["gram"].astype("uint64").tolist()}) + 1
    model = language.build(counts)
    for i, lang in enumerate(("x", "y")):
        own = counts[counts["lang"] == lang]
        plain = PlainKneserNey(dict(zip(own["gram"].astype("uint64").tolist(), own["n"].tolist())), size)
        alphabet = {k % (1 << 16) for k in counts["gram"].astype("uint64").tolist()} | {60_000}
        for context in [*(k >> 16 for k in list(plain.layers[4])[:12]), 12345]:
            assert abs(sum(plain.p((context << 16) + c) for c in alphabet) - 1) < 1e-9
        for text in ("cab", "bad dabba", "zz a", "ace of deeds"):
            codes, start, end, _ = language.letters_of([text])
            keys = language.keys_of(codes)[language._within(codes)].tolist()
            want = -np.mean([np.log(plain.p(k)) for k in keys])
            assert abs(model.entropies(codes, start, end)[0][0, i] - want) < 1e-4


def test_a_small_alphabet_does_not_win_unseen_characters():
    signs = [chr(0x4E00 + i) for i in range(3000)]
    rng = np.random.default_rng(4)
    chinese = ["".join(rng.choice(signs[:1500], 40)) for _ in range(60)]
    model = language.build(grams({"en": ["the cat sat on the mat and the dog ran to the tree"] * 5, "zh": chinese}))
    unseen = "".join(signs[2000:2030])
    half = "".join(a + b for a, b in zip(signs[:15], signs[2000:2015]))
    assert model.predict([unseen, half, "a hat on the tree"])[0] == ["zh", "zh", "en"]


def test_toxicity_on_held_out_rows(spark, labels):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").where("held_out").collect()
    clean = [r.score for r in rows if not r.toxic]
    bad = [r.score for r in rows if r.toxic]
    assert np.mean([b > c for b in bad for c in clean]) > 0.85
    assert np.mean([c >= 0.3 for c in clean]) < 0.05


def test_empty_tables(empty, spark):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made in (
        exact_dedup.exact_dedup(empty),
        jaccard_join.jaccard_groups(empty),
        line_dedup.dedup_lines(empty),
        suffix_dedup.remove_repeats(empty),
        packing.pack(empty),
        piece_tokens.piece_round_trip(empty),
        token_blocks.read_blocks(token_blocks.write_blocks(empty)),
        fingerprints.fingerprints(empty),
        language.identify(empty),
        toxicity.toxicity(empty, no_labels),
    ):
        assert made.count() == 0


def test_passages_keep_every_row(spark):
    rows = [(1, "before " + PASSAGE), (2, PASSAGE), (3, ""), (4, None), (5, "a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.passages(spark, docs, "")
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "before " + PASSAGE, 2: "", 3: "", 4: "", 5: "a text of its own"}
    assert {r.doc_id for r in packing.pieces_of(kept, public_tokenizers.path("byte_bpe_50k.json")).collect()} == {1, 2, 3, 4, 5}


def test_stages_on_odd_rows(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (7, 0, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns and docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage on what the one before kept: survivors, their texts, and the ids that are packed."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    bad = "you are a horrid vile nasty thing"
    texts = [t for t in TEXTS if t] + [f"{bad} number {i} and some words" for i in range(12)]
    texts += [f"kind words number {i} for you" for i in range(30)] + [f"{t} {i}" for i in range(5) for t in TEXTS if t and len(t) < 200]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    labels = [(i, 1, int(bad in t)) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    marked = toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    left = {r.doc_id: texts[r.doc_id] for r in marked if not r.predicted}
    assert not any(bad in t for t in left.values()) and len(left) > len(texts) / 2

    groups: dict[str, list] = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    left = {i: left[i] for i in sorted(min(g)[1] for g in groups.values())}

    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in left for b in left if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closure(left, links)
    left = {i: t for i, t in left.items() if not sets[i] or root[i] == i}

    first: dict[bytes, int] = {}
    raw = {i: t.encode() for i, t in sorted(left.items())}
    for i, b in raw.items():
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        left[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")

    stage = docs
    for k, (_, work) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage = work(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        stage.write.parquet(f"{tmp_path}/stage{k}")
        stage = spark.read.parquet(f"{tmp_path}/stage{k}")
    assert {r.doc_id: r.text for r in stage.collect()} == left

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = {i: [*tokenizer(path).encode(t, add_special_tokens=False).ids, 0] for i, t in left.items()}
    packed_rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces: dict[int, list] = {}
    for r in packed_rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(ids)
