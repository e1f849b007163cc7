"""Language-model scores against a plain recursive model over dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candleworks.llm import lm


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


class Plain:
    """Counts of all n-grams of the training texts, and the interpolated probabilities."""

    def __init__(self, texts):
        own = [split(t) for t in texts]
        self.count = Counter((w,) for t in own for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        for t in own:
            row = ["start", *t]
            self.count[("start",)] += 1
            self.count.update(zip(row, t))
            self.count.update(zip(row, t, t[1:]))
        self.m = {k: self.given(k) for k in (1, 2)}

    def given(self, k):
        """m at which the weight that histories of k words give away is the number of
        n-grams seen once."""
        new = sum(c == 1 for g, c in self.count.items() if len(g) == k + 1)
        histories = [c for g, c in self.count.items() if len(g) == k and g[-1] is not None]
        low, high = 1e-3, 1e6
        for _ in range(100):
            m = math.sqrt(low * high)
            low, high = (m, high) if sum(c * m / (c + m) for c in histories) < new else (low, m)
        return high

    def p(self, history, word):
        if not history:
            return (self.count[(word,)] + 1) / (self.n + self.v + 1)
        c = self.count[history]
        if not c:
            return self.p(history[1:], word)
        m = self.m[len(history)]
        return (self.count[(*history, word)] + m * self.p(history[1:], word)) / (c + m)

    def score(self, text):
        row = ["start", *split(text)]
        return sum(math.log10(self.p(tuple(row[max(0, i - 2) : i]), row[i])) for i in range(1, len(row)))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = ["the", "and", "Straße", "über", "THE", "où"] + [f"w{i}" for i in range(40)]
    some = [" ".join(rng.choice(words, size=int(n))) for n in rng.integers(1, 90, size=60)]
    return [*some, None, "", " \n\t ", some[0], some[0], some[1], "x" * 30_000, "once only", " ".join(rng.choice(words, size=6000)), "a \u00a0 b\x00c"]


@pytest.mark.parametrize(("block", "bucket", "first"), [(4 << 20, 16 << 20, 11), (300, 4000, 11), (1, 1 << 20, 11), (300, 4000, 2), (2000, 20_000, 0)])
def test_scores_are_the_plain_ones(spark, texts, block, bucket, first):
    """With every block size, asking in one step and in two; ids null, repeated and far
    apart, columns that clash."""
    ids = [None if i % 7 == 0 else (i // 2) * 10**12 for i in range(len(texts))]
    rows = [(i, k, t, 0.5, 7, "old") for i, (k, t) in enumerate(zip(ids, texts, strict=True))]
    docs = spark.createDataFrame(rows, "n long, doc_id long, text string, Score double, block int, counts string").repartition(3)
    train = (F.col("n") % 5) != 2
    found = lm.score(docs, train, block_bytes=block, bucket_bytes=bucket, first_bits=first).collect()
    plain = Plain([t for i, t in enumerate(texts) if i % 5 != 2])
    assert sorted(r.n for r in found) == list(range(len(texts)))
    for r in found:
        own = split(r.text)
        assert (r.n_tokens, r.n_known) == (len(own), sum(plain.count[(w,)] > 0 for w in own))
        assert (r.train_tokens, r.held_out, r.doc_id, r.block, r.counts) == (plain.n, r.n % 5 == 2, ids[r.n], 7, "old")
        assert r.base_score == pytest.approx(sum(math.log10((plain.count[(w,)] + 1) / (plain.n + plain.v + 1)) for w in own), abs=1e-8)
        assert r.score == pytest.approx(plain.score(r.text), rel=1e-6)  # frequent histories go by classes


def test_probabilities_of_all_words_sum_to_one():
    plain = Plain(["a b a c", "a b", "b a c c", ""])
    words = ["a", "b", "c", None, "unseen"]
    for history in [(), ("start",), ("a",), ("start", "a"), ("b", "a"), ("c", "c"), ("a", "unseen")]:
        assert sum(plain.p(history, w) for w in words) == pytest.approx(1)


def test_edges(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    unlearned = lm.score(docs, F.lit(False)).collect()
    assert len(unlearned) == len(texts) and all(r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in unlearned)
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    unknown = lm.score(docs, F.lit(None).cast("boolean"), keep=["doc_id"]).collect()
    assert all(r.held_out and r.train_tokens == 0 for r in unknown)
    blank = lm.score(spark.createDataFrame([(None,)] * 3, "text string"), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in blank] == [(1, 1, 3)] * 3


def test_keys_survive_the_wire():
    rng = np.random.default_rng(1)
    for bits, buckets in ((50, 0), (50, 7), (61, 24)):
        keys = lm.Keys(bits, buckets)
        values = np.unique(rng.integers(0, 1 << bits, 5000, dtype=np.uint64))
        bucket = keys.bucket(values)
        for b in np.unique(bucket):
            mine = values[bucket == b]
            back = keys.unpack(keys.pack(mine.copy())) | np.uint64(int(b) << (bits - buckets))
            assert (back == mine).all()


def grouped(rows, columns, by):
    """Tables of the rows of each group, as tasks get them."""
    found = {}
    for row in rows:
        found.setdefault(tuple(row[c] for c in by), []).append(row)
    kinds = {"order": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    return {key: pa.table({c: pa.array([r[c] for r in mine], kinds.get(c, pa.int64())) for c in columns}) for key, mine in found.items()}


def test_two_steps_answer_as_one_and_parts_bound_what_a_bucket_hears():
    """Forty blocks that all hold the same common words: a narrow bucket hears each part once."""
    rng = np.random.default_rng(4)
    far, near, parts = lm.Keys(40, 5), lm.Keys(40, 2), 8
    ask = ["order", "bucket", "chunk", "block", "keys", "counts"]

    def rows_of(keys):
        rng = np.random.default_rng(5)
        for number in range(40):
            texts = [" ".join(["the", "of", *rng.choice([f"w{i}" for i in range(300)], size=20)]).encode() for _ in range(3)]
            block = lm.Block(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
            for order, bucket, raw, counts in lm.asked(block, rng.random(3) < 0.7, keys):
                yield {"order": order, "bucket": bucket, "chunk": number // 6, "block": number, "keys": raw, "counts": counts, "part": number % parts}

    def told(tables):
        by, sums = {}, {}
        for table in tables:
            for r in table.to_pylist():
                if r["block"] is None:
                    key = r["order"], r["class"]
                    sums[key] = np.add(sums.get(key, 0), (r["n"], r["total"], r["history"]))
                else:
                    by.setdefault((r["order"], r["block"]), []).append((r["bucket"], r["counts"]))
        return {k: np.concatenate([lm.restored(c) for _, c in sorted(v)]).tolist() for k, v in by.items()}, {k: v.tolist() for k, v in sums.items()}

    plain, plain_sums = told([lm.answers(far)(t) for t in grouped(rows_of(far), ask, ["order", "bucket"]).values()])
    wide = grouped(rows_of(near), [*ask, "part"], ["order", "bucket", "part"])
    sums = [r for t in wide.values() for r in lm.gathered(near, far)(t).to_pylist()]
    narrow = grouped(sums, ask, ["order", "bucket"])
    assert max(t.num_rows for t in narrow.values()) <= parts
    answered = [lm.answers(far)(t) for t in narrow.values()]
    back = [r | {"wide": r["bucket"] >> 3} for t in answered for r in t.to_pylist() if r["block"] is not None]
    of = grouped(back, ["bucket", "counts"], ["order", "wide", "block"])
    shuffled = lambda t: t.take(pa.array(rng.permutation(t.num_rows)))
    passed = [lm.passed_on(near)(shuffled(t), of[key]) for key, t in wide.items()]
    assert told(passed)[0] == plain
    assert told(answered)[1] == plain_sums
