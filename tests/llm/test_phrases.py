"""Phrases against a plain count of all contiguous words."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleworks.llm import phrases
from candleworks.llm.common import text_column

SCHEMA = "doc_id long, text string, lang string, m int, gram string, rank int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts_of(rows, size):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, size + 1):
                for i in range(len(w) - m + 1):
                    f[(lang or "und", tuple(w[i : i + m]))] += 1
    return f, n


def brute(rows, size=5, least=100, top=2000, whole=100):
    f, n = counts_of(rows, size)
    good = {k: v for k, v in f.items() if v >= least}
    inside = {}
    for (lang, words), v in good.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    inside[(lang, words[i:j])] = max(v, inside.get((lang, words[i:j]), 0))
    out = {}
    for (lang, words), a in good.items():
        if len(words) < 2 or 100 * inside.get((lang, words), -1) >= whole * a:
            continue
        cut = min((1000 * a * n[lang] // (f[(lang, words[:k])] * f[(lang, words[k:])]), k) for k in range(1, len(words)))
        l, r = f[(lang, words[: cut[1]])], f[(lang, words[cut[1] :])]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocabulary = ["The", "of", "é", "a", "straße", "\U0001f600", "x-y", "ÀB", "|"]
    out = []
    for i in range(120):
        words = list(rng.choice(vocabulary, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05], size=int(rng.integers(0, 60))))
        for _ in range(len(words) // 8):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice([".", "\n", ", ", "one two three four five six", "Rate of\tChange", "  \t "])))
        out.append((i, " ".join(words), [None, "en", "und", "de", "en"][i % 5], 1, "g", 2))
    return out + [(900, None, "en", 1, "g", 2), (901, "", "fr", 1, "g", 2), (902, " \t;;", None, 1, "g", 2), (903, "a " * 5000, "en", 1, "g", 2), out[0], out[0], (None, "rate of change", "xx", 1, "g", 2)]


@pytest.mark.parametrize(("size", "least", "top", "whole"), [(5, 20, 2000, 100), (3, 5, 10, 80), (2, 1, 2000, 100), (5, 2, 50, 50)])
def test_phrases_are_those_of_a_plain_count(spark, rows, size, least, top, whole):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = phrases.collocations(docs, size=size, least=least, top=top, whole_share=whole)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, size, least, top, whole)


def test_a_full_bitmap_changes_nothing(spark, rows):
    """What the bitmap lets through by chance is counted and then seen to be rare."""
    docs = spark.createDataFrame(rows, SCHEMA)
    found = phrases.collocations(docs, least=20, max_bits=1)
    assert sorted(map(tuple, found.collect())) == brute(rows, least=20)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_column("text"))
    every = phrases.gram_counts(texts, np.full(4096, 255, dtype=np.uint8))
    f, n = counts_of(rows, 5)
    got, words = Counter(), Counter()
    for r in every.collect():
        words[r.lang] += r.c
        for k in range(1, r.m + 1):  # flow: all that begins with a node's words
            got[(r.lang, tuple(r.gram.split(" ")[:k]))] += r.c
    assert got == f and words == +n


def test_held_rows_are_passed_on(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 40)
    monkeypatch.setattr(phrases, "BYTES", 100)
    monkeypatch.setattr(phrases, "SMALL", 0)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, phrases.collocations(docs, least=20).collect())) == brute(rows, least=20)


def test_equal_hashes_of_unequal_words_are_told_apart(monkeypatch):
    whole = phrases.hash_spans
    monkeypatch.setattr(phrases, "hash_spans", lambda data, starts, ends, table: whole(data, starts, ends, table) if table is phrases._OTHER else np.full(len(starts), 7, dtype=np.uint64))
    data = np.frombuffer(b"b a b c", dtype=np.uint8)
    words = phrases.Words(data, np.array([0, 7]), np.zeros(1, np.int64), np.zeros(1, np.uint64))
    first, number = words.numbers()
    assert number.tolist() == [1, 0, 1, 2] and len(first) == 3


def test_large_counts_are_exact(spark):
    """The products of the score pass 64 bits."""
    a, n, l, r = 9_000_000_000_007, 19_999_999_999_999, 9_100_000_000_003, 9_200_000_000_009
    wide = lambda x: f"CAST({x}L AS DECIMAL(19,0))"
    got = spark.sql(f"SELECT (CAST(1000 AS DECIMAL(4,0)) * {wide(a)} * {wide(n)}) DIV ({wide(l)} * {wide(r)})").first()[0]
    assert got == 1000 * a * n // (l * r)


def test_no_documents(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
