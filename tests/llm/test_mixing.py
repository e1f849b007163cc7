"""Mixing against a plain version that reshares the excess round by round."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candleworks.llm import mixing
from candleworks.llm.ordinals import running

SCHEMA = "doc_id long, text string, source string, target double, u int, key string, copies string"
SF = "/root/testdata/sf0.01"


def words(n):
    return " ".join(["w\t"] * n) if n else ""


def brute_targets(sizes, weights, share, most):
    """sizes by source; weights by source. Rounds: share out, cap, reshare the excess."""
    full, left = {}, share * sum(sizes.values())
    while True:
        open_ones = [s for s in sizes if s not in full and weights[s] > 0]
        total = sum(weights[s] for s in open_ones)
        part = {s: left * weights[s] / total for s in open_ones}
        over = [s for s in open_ones if part[s] >= most * sizes[s]]
        if not over:
            return {s: full.get(s, part.get(s, 0.0)) for s in sizes}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


@pytest.fixture(scope="module")
def docs(spark):
    rows, i = [], 0
    for source, n in (("b", 40), ("a", 3), (None, 7), ("", 9), ("é", 2), ("Z", 30), ("\U0001f600", 5), ("￿", 4)):
        for k in range(n):
            rows.append((i, [words(k * 3), None, "", "   ", words(11)][k % 5] if k else words(100), source, 1.0, 5, "k", "c"))
            i += 1
    rows += [rows[0], rows[0], (None, words(6), "a", 1.0, 5, "k", "c"), (7001, words(30_000), "b", 1.0, 5, "k", "c"), (7002, None, "empty", 1.0, 5, "k", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize(("share", "most"), [(1.5, 2.0), (0.4, 2.0), (2.0, 2.0), (3.0, 3.5), (0.0, 2.0)])
def test_targets_are_reshared_until_none_is_above(docs, share, most):
    rows = mixing.plan(docs, (3, 1, 2), share, most).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        assert r.size == len(re.findall("[^ \t-\r]+", r.text or ""))
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = brute_targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, share, most)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0.0
        digest = hashlib.md5(("mix:" + ("" if r.doc_id is None else str(r.doc_id))).encode()).hexdigest()
        assert r.copies == int(rate) + (int(digest[:13], 16) / 2**52 < rate - int(rate))
        assert r.copies <= -(-most // 1)
        assert (r.u, r.key) == (5, "k")


def test_weights_by_name_and_both_joins(spark, docs, monkeypatch):
    given = spark.createDataFrame([("a", 1.0), (None, 4.0), ("b", 0.5), ("not there", 9.0)], "source string, weight double")
    rows = mixing.plan(docs, given, 0.001, 2.0, keep=["doc_id", "source"]).collect()
    target = {r.source: r.target for r in rows}
    assert target["Z"] == 0 and target[None] == pytest.approx(4 * target["a"]) and target["b"] == pytest.approx(target["a"] / 2)
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(str, mixing.plan(docs, given, 0.001, 2.0, keep=["doc_id", "source"]).collect())) == sorted(map(str, rows))


def test_mix_emits_each_copy(docs):
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[(r.doc_id, r.text)] += r.copies
    mixed = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == +plan
    assert {r.copy for r in mixed} <= {1, 2}
    assert mixing.mix(docs, copy_col="u").columns == ["doc_id", "text", "source", "key", "u"]


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_taken_words_come_near_the_targets(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    by = mixing.plan(table, keep=["doc_id", "source"]).groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"),
        F.sum(F.col("size") ** 2 * (F.col("rate") % 1) * (1 - F.col("rate") % 1)).alias("variance"),
    ).collect()
    assert all(abs(r.taken - r.target) <= 4 * r.variance**0.5 + 1e-6 for r in by)
    whole, target = sum(r.taken for r in by), sum(r.target for r in by)
    assert abs(whole - target) < 0.05 * target


def test_running_sums_over_many_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    rows = running(df, [F.col("k")], {"before": F.col("k"), "place": F.lit(1)}).collect()
    assert len(rows) == 1000 and all((r.before, r.place) == (r.k * (r.k - 1) // 2, r.k) for r in rows)
