"""Fingerprint bits and toxicity features against plain versions in integers and sets."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

from haulmark.llm import fingerprints, toxicity

MASK = (1 << 64) - 1
WHITE = " \t\n\x0b\x0c\r"


def texts(n):
    """Nulls, blanks, lone words, wide signs, repeats, near copies, and texts of random words."""
    rng = random.Random(5)
    words = [f"w{i}" * rng.randint(1, 9) for i in range(200)] + ["é", "🙂", "日本語", "a" * 40]
    made = [None, "", " \t\n", "alone", " alone\n", "two words", "tab\there\x0band  there", "a" * 70 + " " + "b" * 40]
    while len(made) < n:
        text = "".join(rng.choice(words) + rng.choice(" \n") for _ in range(rng.randint(2, 300)))
        made += [text, text, text.replace("w7", "v7", 1)] if rng.random() < 0.3 else [text]
    return made[:n]


def bits(text):
    """128 bits as one number: each term's bits, every bit by the larger share of the weight."""
    words = re.split(r"[\x20\x09-\x0D]+", text.strip(WHITE))
    pairs = list(zip(words, words[1:])) or [(words[0],)]
    total, votes = 0, [0] * 128
    for pair in pairs:
        h = 42
        for word in pair:
            h = xxhash.xxh64(word.encode(), seed=h).intdigest()
        second = xxhash.xxh64(h.to_bytes(8, "little"), seed=42).intdigest()
        second = xxhash.xxh64((1).to_bytes(4, "little"), seed=second).intdigest()
        weight = min(sum(map(len, pair)), fingerprints.HEAVIEST)
        total += weight
        for j in range(64):
            votes[j] += weight * (second >> j & 1)
            votes[64 + j] += weight * (h >> j & 1)
    return sum(1 << j for j, v in enumerate(votes) if 2 * v > total)


def test_fingerprints_equal_plain_votes(spark):
    given = [(3 * i if i else None, t) for i, t in enumerate(texts(120))]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert len(got) == len(given)
    rows = sorted(((d, t or "") for d, t in given), key=lambda r: (r[0] is None, r[0] or 0))
    own = [bits(t) for _, t in rows]
    for i, (doc, text) in enumerate(rows):
        after = (i + 1) % len(rows)
        cut = len(text) // 4
        edited = text[: len(text) - cut] + rows[after][1][:cut]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert int(r.fingerprint, 16) == own[i]
        assert int(r.edited_fingerprint, 16) == bits(edited)
        assert r.near_edited == 1 - (own[i] ^ bits(edited)).bit_count() / 128
        assert r.near_next == 1 - (own[i] ^ own[after]).bit_count() / 128
        near = sum((own[i] ^ other).bit_count() <= fingerprints.RADIUS for other in own)
        assert r.n_near == (near if doc is not None and doc % fingerprints.QUERY_STEP == 0 else None)


def slots(text):
    """The distinct n-gram slots of a text."""
    codes = [ord(c) for c in f" {text} ".replace("\0", " ").lower()]
    scrambled = [c * 0x9E3779B97F4A7C15 & MASK for c in codes]
    scrambled = [m ^ m >> 29 for m in scrambled]
    found = set()
    for order in toxicity.ORDERS:
        for i in range(len(codes) - order + 1):
            h = 0
            for m in scrambled[i : i + order]:
                h = (h * 0xD6E8FEB86659FD93 + m) & MASK
            x = h * (0xA0761D6478BD642F + 2 * order) & MASK
            found.add(((x ^ x >> 32) * 0xE7037ED1A0B428DB & MASK) >> 64 - toxicity.BITS)
    return found


@pytest.fixture(scope="module")
def labelled():
    """Texts of one vocabulary; those with label 1 also hold words of their own. Some labels are held out or null."""
    rng = random.Random(9)
    calm, foul = [f"calm{i}" for i in range(30)], ["vilest", "Rotten", "wretch"]
    rows = []
    for doc in range(160):
        toxic = int(doc % 4 == 1)
        words = [rng.choice(calm) for _ in range(rng.randint(0, 25))] + [rng.choice(foul) for _ in range(2 * toxic)]
        rng.shuffle(words)
        rows.append((doc, " ".join(words) if doc else None, None if doc % 31 == 7 else toxic))
    return rows


def test_toxicity_features_equal_plain_counts(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, t) for d, _, t in labelled], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, features=300)

    sets = [slots(t or "") for _, t, _ in labelled]
    learned = [(s, t) for s, (d, _, t) in zip(sets, labelled) if t is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    size = [sum(t == label for _, t in learned) for label in (0, 1)]
    count = {}
    for found, label in learned:
        for slot in found:
            count.setdefault(slot, [0, 0])[label] += 1

    def tell(slot):
        clean, toxic = count[slot]
        mean = (toxic + clean) / sum(size)
        return (toxic / size[1] - clean / size[0]) ** 2 / (mean * (1.0001 - mean))

    chosen = {int(s): int(f) for s, f in enumerate(model.wanted) if f >= 0}
    often = [s for s, n in count.items() if sum(n) >= 3]
    assert len(often) > 300 and set(chosen) <= set(often)
    assert sorted(chosen.values()) == list(range(300))
    # Equal tellings may round differently, so their values are compared and not the slots.
    assert sorted(map(tell, chosen), reverse=True) == pytest.approx(sorted(map(tell, often), reverse=True)[:300])

    for slot, feature in chosen.items():  # a weight is a finite multiple of the log-count ratio
        clean, toxic = count[slot]
        ratio = math.log((toxic + 1) / (size[1] + 2)) - math.log((clean + 1) / (size[0] + 2))
        assert math.isfinite(model.weights[feature]) and (abs(ratio) > 1e-12 or abs(model.weights[feature]) < 1e-9)

    got = {r.doc_id: r for r in toxicity.scored(docs, model, "doc_id").collect()}
    for (doc, _, toxic), found in zip(labelled, sets):
        score = 1 / (1 + math.exp(-(model.intercept + sum(model.weights[chosen[s]] for s in found if s in chosen))))
        assert got[doc].score == pytest.approx(score)
        if toxic is not None:
            assert (got[doc].score >= toxicity.THRESHOLD) == bool(toxic)
