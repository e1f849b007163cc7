"""Phrase collocations from a weighted de Bruijn graph of word grams.

At each word of a piece begins one longest gram: five words, or fewer where the piece
ends. Longest grams are the edges of the graph, from the node of their first words to
that of their last; what is cut short is a correction at the end of a piece. Edges are
counted once. The flow out of a node, with its corrections, is how often the node's own
words occur, and so on down to single words, so no shorter gram is counted in the texts.
A node whose whole flow runs through one edge is compacted into it: those are the
phrases that a longer one contains as often.

Most edges cannot belong to a phrase that occurs `least` times: one of their word pairs
is rarer. Pairs are counted first, by 40 bits of a hash, which can only count too much,
and a bitmap of those that are frequent is broadcast. A gram also ends, with a
correction, before a pair that is surely rare. Every occurrence of a frequent phrase lies
within grams of frequent pairs, so its flow is whole; grams are counted by their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MAX_BITS, bitmap_of, durable, hash_spans, in_bitmap, mix64, release, slices, spans_of, text_column, utf8

SIZE, LEAST, TOP = 5, 100, 2000

#: ASCII bytes that end a piece, and those and blanks, which end a word.
BREAK = np.zeros(256, dtype=bool)
BREAK[np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", dtype=np.uint8)] = True
GAP = BREAK.copy()
GAP[[32, 9]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cased bytes in another order, for a second, independent hash.
_OTHER = np.roll(np.arange(256, dtype=np.uint8), 101)[LOWER]

#: Bits of a pair's key, bytes of text worked on at once, keys or grams held in a task.
KEY_BITS, BYTES, HELD = 40, 2 << 20, 1 << 19
#: Bytes of the table of counts that is broadcast at most.
SMALL = 32 << 20


class Words:
    """The words of some texts: where they are, their hashes, their texts' languages, and
    whether the next word follows in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, lang_hash: np.ndarray):
        self.data = data
        self.starts, self.ends, doc = spans_of(data, offsets, GAP)
        piece = np.cumsum(BREAK[data], dtype=np.int64)[self.starts] if len(data) else np.empty(0, np.int64)
        self.follows = np.zeros(len(self.starts), dtype=bool)
        self.follows[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        self.lang = lang[doc]
        self.hash = hash_spans(data, self.starts, self.ends, LOWER)
        self.salt = lang_hash[self.lang]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a word and the next make a pair, and the pairs' keys."""
        at = np.flatnonzero(self.follows)
        return at, mix64(self.hash[at] * _STEP + self.hash[at + 1] + self.salt[at]) >> np.uint64(64 - KEY_BITS)

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each distinct word, and each word's number. Equal hashes of
        unequal words show in a second hash; then the words themselves are compared."""
        _, first, of = np.unique(self.hash, return_index=True, return_inverse=True)
        again = hash_spans(self.data, self.starts, self.ends, _OTHER)
        if (again != again[first][of]).any():
            lowered = LOWER[self.data].tobytes()
            words = np.array([lowered[a:b] for a, b in zip(self.starts, self.ends, strict=True)], dtype=object)
            _, first, of = np.unique(words, return_index=True, return_inverse=True)
        return first, of


def _texts(batches):
    """(Words, languages) of slices of the batches (lang, __text)."""
    for batch in batches:
        coded = pc.dictionary_encode(batch.column("lang"))
        names = coded.dictionary.to_pylist()
        hashes = np.array([xxhash.xxh64_intdigest(n.encode()) for n in names], dtype=np.uint64)
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = utf8(batch.column("__text"))
        for i, j in slices(offsets, BYTES):
            yield Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lang[i:j], hashes), names


def pair_counts(texts: DataFrame) -> DataFrame:
    """(key, c) of the word pairs of texts (lang, __text)."""

    def run(batches):
        def flush(held):
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 17)].astype(np.int64)), pa.array(c[i : i + (1 << 17)].astype(np.int32))], names=["key", "c"])

        held, n = [], 0
        for words, _ in _texts(batches):
            held.append(words.pairs()[1])
            n += len(held[-1])
            if n > HELD:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return texts.mapInArrow(run, "key long, c int").groupBy("key").agg(F.sum("c").alias("c"))


def longest_grams(words: Words, likely: np.ndarray, size: int = SIZE):
    """(language number, words, how often) of the longest grams that begin at the words."""
    if not len(words.starts):
        return
    joined = np.zeros(len(words.starts) + size, dtype=bool)
    at, key = words.pairs()
    joined[at] = in_bitmap(likely, key)
    length = np.ones(len(words.starts), dtype=np.int64)
    on = np.ones(len(words.starts), dtype=bool)
    for k in range(size - 1):
        on &= joined[k : k + len(on)]
        length += on
    first, number = words.numbers()
    lowered, starts, ends = LOWER[words.data].tobytes(), words.starts.tolist(), words.ends.tolist()
    for m in range(1, size + 1):
        place = np.flatnonzero(length == m)
        if not len(place):
            continue
        gram = words.lang[place]
        for k in range(m):
            _, one, gram, counts = np.unique(gram * len(first) + number[place + k], return_index=True, return_inverse=True, return_counts=True)
        where = place[one]
        for p, lang, c in zip(where.tolist(), words.lang[where].tolist(), counts.tolist(), strict=True):
            yield lang, m, b" ".join([lowered[starts[q] : ends[q]] for q in range(p, p + m)]), c


def gram_counts(texts: DataFrame, likely: np.ndarray, size: int = SIZE) -> DataFrame:
    """(lang, m, gram, c): how often each longest gram of m words begins."""
    shared = texts.sparkSession.sparkContext.broadcast(likely.tobytes())

    def run(batches):
        def flush(held):
            rows = list(held)
            for i in range(0, len(rows), 1 << 16):
                lang, m, gram = zip(*rows[i : i + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(m, pa.int32()), pa.array(gram, pa.binary()).cast(pa.string()), pa.array([held[r] for r in rows[i : i + (1 << 16)]], pa.int64())], names=["lang", "m", "gram", "c"])

        bits = np.frombuffer(shared.value, dtype=np.uint8)
        held: dict[tuple, int] = {}
        for words, names in _texts(batches):
            for lang, m, gram, c in longest_grams(words, bits, size):
                key = (names[lang], m, gram)
                held[key] = held.get(key, 0) + c
            if len(held) > HELD // 4:
                yield from flush(held)
                held = {}
        if held:
            yield from flush(held)

    return texts.mapInArrow(run, "lang string, m int, gram string, c long").groupBy("lang", "m", "gram").agg(F.sum("c").alias("c"))


def _small(df: DataFrame, text: str) -> DataFrame:
    """df, to be broadcast if it is small."""
    n = df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return F.broadcast(df) if n <= SMALL else df


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SIZE, least: int = LEAST, top: int = TOP, whole_share: int = 100, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    A-Z count as lower case. Texts are cut into pieces at ASCII .,;:!? and line ends, and
    pieces into words at blanks and tabs. Phrases have 2 to `size` words and occur (a)
    `least` times or more, overlaps included; n is all words of the language. Of the ways
    to cut a phrase in two (l and r occurrences) the one of the least score, floor(1000 a n
    / (l r)), counts, the earliest of equal ones. A phrase that a longer one contains goes
    if the longer one has at least whole_share % of its occurrences. Order: score and a
    falling, then the phrase's bytes. Null texts are empty, a null language is `und`. No
    documents, no rows; repeated rows count as often as they are there.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_column(text_col))
    frequent = durable(pair_counts(texts).where(F.col("c") >= least).select("key"))
    grams = durable(gram_counts(texts, bitmap_of(frequent, max_bits), size))
    release(frequent)
    n_words = grams.groupBy("lang").agg(F.sum("c").alias("n"))
    # the flow out of a node is that of all edges which begin with its words
    nodes = grams.select("lang", F.explode(F.sequence(F.lit(1), "m")).alias("m"), "gram", "c")
    nodes = nodes.select("lang", "m", F.expr("substring_index(gram, ' ', m)").alias("phrase"), "c")
    counts = durable(nodes.groupBy("lang", "m", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least))
    end = lambda which: F.expr(f"substring_index(phrase, ' ', {which})")
    # nodes whose flow runs through one edge, forwards or backwards
    edges = counts.where("m > 2").select("lang", F.explode(F.array(end("m - 1"), end("1 - m"))).alias("phrase"), "f")
    edges = edges.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    found = counts.where("m > 1").join(edges, ["lang", "phrase"], "left")
    found = found.where(F.col("longer").isNull() | (100 * F.col("longer") < whole_share * F.col("f")))
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", end("k").alias("left"), end("k - m").alias("right"))
    known = _small(counts.select("lang", "phrase", "f"), "phrase")
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    known_n = _small(n_words, "lang")
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(known_n, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {wide('a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task ranks a whole one
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
