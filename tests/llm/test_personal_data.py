"""Patterns against the plain regular expressions, disclosure against counts over all documents."""

import hashlib
import math
import random
import re

import pytest

from haulmark.llm import personal_data as pii

SCHEMA = "doc_id long, text string, lang string, key string, k int, base int, `a.b` int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else 2 * int(d) - 9 * (int(d) > 4)
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m, digits: True,
                "ip": lambda m, digits: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m, digits: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda m, digits: 10 <= len(digits) <= 15,
            }[kind]
            if good(m, digits):
                out.append((m.start(), list(PATTERNS).index(kind), m.end()))
    return sorted(out)


def test_patterns_equal_the_regular_expressions():
    rng = random.Random(4)
    pieces = ["@", ".", "-", "+", " ", "(", ")", "a", "B.c", "x%", "1", "25", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999",
              "me@host.org", "10.0.0.1", "é", "0", "..", "@@", "٣", "\n", "79927398713000", "a@b.c@d.e"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "a@", "+", "1 ", "+1 ", "a.", "(", "@a-", "999.9.9.9."])
def test_long_texts_take_linear_time(piece):
    pii.base_spans(piece * (2_000_000 // len(piece)))


def plain(rows):
    """Spans of every row, statistics counted one by one."""
    docs = sorted({(i, t or "") for i, t in rows}, key=str)
    seen = []
    for doc in docs:
        spans = plain_base(doc[1])
        covered = {i for a, _, b in spans for i in range(a, b)}
        terms = [m for m in re.finditer(r"[^\W_]{3,}", doc[1]) if not covered & set(range(m.start(), m.end()))]
        for a, kind, b in spans:
            left = [m for m in terms if m.end() <= a][-pii.WINDOW :]
            right = [m for m in terms if m.start() >= b][: pii.WINDOW]
            value = doc[1][a:b]
            value = value.lower() if kind == 0 else value if kind == 1 else re.sub("[^0-9]", "", value)
            seen.append((doc, (kind, value), str([[m[0].lower() for m in s] for s in (left, right)]), left + right))
    first = {}
    for doc, e, ctx, _ in seen:
        one = (pii.row_key(*doc), doc)
        first[e, ctx] = min(first.get((e, ctx), one), one, key=lambda x: x[0])
    n_e, n_te, n_t = {}, {}, {}
    for (e, ctx), (_, doc) in first.items():
        n_e.setdefault(e, set()).add(doc)
        for d, e2, c2, near in seen:
            if (d, e2, c2) == (doc, e, ctx):
                for m in near:
                    for f in (m[0].lower(), m[0].lower()[:3] + "*"):
                        n_te.setdefault((e, f), set()).add(doc)
    for _, t in rows:
        words = {w.lower() for w in re.findall(r"[^\W_]{3,}", t or "")}
        for f in words | {w[:3] + "*" for w in words}:
            n_t[f] = n_t.get(f, 0) + 1
    high = set()
    for (e, f), those in n_te.items():
        if len(those) >= pii.SUPPORT and len(n_e[e]) < len(rows):
            d = math.log(len(rows) * len(those) / (n_t[f] * len(n_e[e]))) / math.log(len(rows) / len(n_e[e]))
            if d >= pii.THRESHOLD:
                high.add((e, f))
    out = {}
    for doc in docs:
        spans = [(a, k, b, None) for a, k, b in plain_base(doc[1])]
        own = {}
        for d, e, _, near in seen:
            if d == doc:
                for m in near:
                    w = m[0].lower()
                    if (e, w) in high:
                        gone = len(w) <= 3 or (e, w[:3] + "*") in high
                        own[m.start(), 4, m.end()] = None if gone or own.get((m.start(), 4, m.end()), "") is None else w[:3] + "*"
        out[doc] = sorted(spans + [(*k, v) for k, v in own.items()], key=str)
    return out


def corpus():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "amet", "con") for b in ("em", "um", "or", "is", "ect", "ur")]
    rows = []
    for i in range(300):
        text = [rng.choice(words) for _ in range(30)]
        if i % 9 == 0:  # an address with its owner's name, and with a word that others use too
            text[10:10] = ["Zbigniew", f"Mail{i % 2}", "zb@corp.example.com", "loring"]
        if i % 11 == 0:
            text[20:20] = ["call", "Xaq", "+1 (555) 010-9999", "tonight"]
        rows.append((i, " ".join(text)))
    rows += [(400 + i, "copied context Hapaxleg here one@two.example.org and more") for i in range(50)]
    rows += [(500, None), (501, ""), (None, "no id zb@corp.example.com"), (3, rows[3][1]), (500, None), (502, "w" * 3_000 + " a@b.cd")]
    return rows


@pytest.mark.parametrize("threshold", [0.8, 0.6])
def test_spans_equal_plain_counts(spark, monkeypatch, threshold):
    monkeypatch.setattr(pii, "THRESHOLD", threshold)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "en", "clash", 1, 2, 3) for r in rows], SCHEMA)
    want = plain(rows)
    found = pii.personal_data(docs.repartition(4)).collect()
    assert len(found) == len(rows)
    texts = {}
    for r in found:
        spans = [(s.start, s.kind, s.end, None) for s in r.base] + [tuple(s) for s in r.terms or []]
        texts.setdefault(r.doc_id, []).append(sorted(spans, key=str))
    for (i, t), spans in want.items():
        assert spans in texts[i], (i, t)
    named = {t[s[0] : s[2]] for (_, t), spans in want.items() for s in spans if s[1] == 4}
    assert {"Zbigniew", "Xaq"} <= named and "Hapaxleg" not in named
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    by = {r.doc_id: r.text for r in clean.collect()}
    assert "Zbigniew" not in by[9] and "[EMAIL]" in by[9] and by[1] == rows[1][1] and by[500] is None
    assert by[502].endswith(" [EMAIL]")


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pii.personal_data(docs).count() == 0 and pii.sanitised(docs).count() == 0


def test_query_digests(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in pii.op11_personal_data(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = plain([tuple(r) for r in docs])
    for (i, _), spans in want.items():
        r = found[i]
        base = [s for s in spans if s[1] < 4]
        base.sort(key=lambda s: s[:3])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        every = sorted(spans, key=lambda s: s[:3])
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in every)
    assert len(found) == len(docs)
