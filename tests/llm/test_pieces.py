"""Ids by pieces: equal to the library's wherever texts are cut, and each piece encoded about once."""

import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest

from haulmark.llm import byte_tokens
from haulmark.llm.byte_tokens import ByteLevel, PieceTable, WordLevel, _pieces, tokenizer

FILES = {"byte_bpe_50k.json": ByteLevel, "word_bpe_49k.json": WordLevel}
ODD = [*"aBz' \n\t=<_-.,!?§İΣéß中😀٣½”\x00\x1c\x85\xa0̸́ 　K", "the", "re", "'s", "'re", "42", "  ", "<|endoftext|>"]


@pytest.mark.parametrize("name", FILES)
def test_ids_of_cut_texts_equal_the_library(name):
    rnd = random.Random(7)
    path = public_tokenizers.path(name)
    texts = ["".join(rnd.choices(ODD, [3] * 10 + [1] * (len(ODD) - 10), k=rnd.randint(0, 12))) for _ in range(6000)]
    texts += ["", " ", "\n", "a ", " a", "\xa0", "x\xa0", "it's 'sa &'s.", "a" * 5000, "+41 44-555(12)", "That.\nThis&&&"]
    want = [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    encoder = FILES[name](path)
    for _ in range(2):  # the second time from the table
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


@pytest.mark.parametrize("name", FILES)
def test_a_word_is_encoded_once_whatever_marks_follow(name):
    encoder = FILES[name](public_tokenizers.path(name))
    solve, seen = encoder.table.solve, []
    encoder.table.solve = lambda pieces: (seen.extend(pieces), solve(pieces))[1]
    encoder.encode(["so onthering. So"])
    encoder.encode(["so onthering, onthering&&&\nSo onthering."])
    assert sum("onthering" in p for p in seen) == 1


def test_many_words_stay_in_the_table():
    encoder = WordLevel(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    encoder.table.solve = lambda pieces: (asked.append(len(pieces)), [b"\1\0\0\0"] * len(pieces))[1]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(a + b + c + d for c in letters for d in letters) for a in letters for b in letters]
    encoder.encode(texts)  # 456,976 words
    asked.clear()
    encoder.encode(texts)
    assert sum(asked) < 456_976 // 10


def test_pieces_that_share_slots_and_a_full_table():
    asked = []
    solve = lambda pieces: (asked.extend(pieces), [np.frombuffer(p.encode(), np.uint8).astype("<u4").tobytes() for p in pieces])[1]
    table = PieceTable(solve, slots=8, most=500)
    rnd = random.Random(3)
    words = ["a", "a\0", "a\0\0", "é", "x" * 15, "x" * 16, "x" * 15 + "y", *("".join(rnd.choices("abc\0", k=rnd.randint(1, 20))) for _ in range(60))]
    for _ in range(40):
        text = " ".join(rnd.choices(words, k=30))
        data, start, size, _ = _pieces([text], True)
        ids, n = table.ids(data, start, size)
        assert ids.tolist() == list(text.encode()) and n.tolist() == size.tolist()
    assert table.used < 500 + 30 * 21


def test_words_in_capitals_share_the_entry_of_the_small_ones():
    encoder = WordLevel(public_tokenizers.path("word_bpe_49k.json"))
    solve, seen = encoder.table.solve, []
    encoder.table.solve = lambda pieces: (seen.extend(pieces), solve(pieces))[1]
    small, mixed, large = encoder.encode(["onthering so", "Onthering So", "ONTHERING SO"])
    assert small == mixed == large and sorted(seen) == ["onthering", "so"]


def test_small_letters_need_no_normalizing():
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = [c for c in map(chr, range(0x600)) if byte_tokens._PLAIN.fullmatch(c)]
    assert all(c.isalpha() and c == c.lower() == unicodedata.normalize("NFC", c) for c in letters)
    rnd = random.Random(5)
    words = letters + ["".join(rnd.choices(letters, k=rnd.randint(1, 9))) for _ in range(5000)]
    got, want = (t.encode_batch_fast(words, add_special_tokens=False) for t in (byte_tokens.plain_tokenizer(path), tokenizer(path)))
    assert [e.ids for e in got] == [e.ids for e in want]


def test_capitals_beside_marks_that_join_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = random.Random(11)
    signs = [*"HITEAKSaeh' .,1\n", "\u0331", "\u0301", "\u0307", "\u0308", "\u030a", "\u0130", "\u0131", "\u017f", "\u212a", "\u03a3", "\u00df", "\u1e9e", "\u00c9"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(1, 9))) for _ in range(5000)] + ["H\u0331 h\u0331", "I\u0307", "THE 'S", "<|ENDOFTEXT|>", "a<|EndOfText|>é"]
    want = [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in WordLevel(path).encode(texts)] == want
