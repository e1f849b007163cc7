"""Exact near-duplicates by word shingles, and the pipeline's stage of them."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from candleworks.llm import shingles, simhash
from tests.llm.test_operators import union_find


def brute_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near_texts():
    """Texts and copies of them with a few words changed, around and below 0.8; a large
    group of copies of one, and short and null ones."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [list(rng.choice(vocabulary, size=int(n))) for n in rng.integers(20, 200, size=25)]
    for base in texts[:25]:
        for changes in (1, 2, 3, 5):
            copy = list(base)
            for at in rng.choice(len(copy), size=min(len(copy), changes), replace=False):
                copy[at] = "changed"
            texts.append(copy)
    for _ in range(40):
        copy = list(texts[0])
        copy[int(rng.integers(len(copy)))] = str(rng.integers(1000))
        texts.append(copy)
    return [" ".join(t) for t in texts] + [None, "", "  ", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("lags", [64, 2])
def test_shingles_equal_brute_force(spark, lags):
    texts = near_texts()
    sets = [brute_set(t) for t in texts]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, lags=lags).collect()}
    assert [found[i] for i in range(len(texts))] == union_find(len(texts), close)
    assert shingles.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_a_token_in_many_tasks(spark, parts, monkeypatch):
    """Copies of one text that differ in a word or two share their first shingles; their
    rows are cut over tasks and over blocks, and no link is lost."""
    monkeypatch.setattr(shingles.DataFrame, "repartitionByRange", lambda self, *c, f=shingles.DataFrame.repartitionByRange: f(self, parts, *c))
    rng = np.random.default_rng(5)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(70):
            copy = list(base)
            for at in rng.choice(60, size=int(rng.integers(1, 4)), replace=False):
                copy[at] = f"n{rng.integers(10_000)}"
            texts.append(" ".join(copy))
    sets = [brute_set(t) for t in texts]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs, lags=3, block=16).collect()}
    assert [found[i] for i in range(len(texts))] == union_find(len(texts), close)


def test_template_texts_send_no_pairs_to_be_compared(spark, monkeypatch):
    """Texts of 204 common and 36 own words are all below the similarity, as their sizes
    and places show."""
    sent, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda pairs, *a: (sent.append(pairs.count()), verified(pairs, *a))[1])
    common = " ".join(f"c{i}" for i in range(204))
    docs = spark.createDataFrame([(i, common + " " + " ".join(f"o{i}x{k}" for k in range(36))) for i in range(300)], "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in shingles.near_duplicates(docs).collect())
    assert sum(sent) == 0


def test_a_common_passage_sends_no_pairs_to_be_compared(spark, monkeypatch):
    """Texts that share a fifth of their words, in groups too wide to be met at once, are
    too few first shingles short of the similarity."""
    sent, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda pairs, *a: (sent.append(pairs.count()), verified(pairs, *a))[1])
    common = " ".join(f"c{i}" for i in range(24))
    docs = spark.createDataFrame([(i, common + " " + " ".join(f"o{i}x{k}" for k in range(96))) for i in range(100)], "doc_id long, text string")
    assert all(r.doc_id == r.component_id for r in shingles.near_duplicates(docs, lags=3, sample=0).collect())
    assert sum(sent) == 0


def test_whole_sets_travel_only_for_pairs_that_may_be(spark, monkeypatch):
    """Pairs of unlike texts are told apart by counts of a tenth of the bytes; like ones pass."""
    made = []

    def durable(df, f=shingles.durable):
        table = f(df)
        if "values" in table.columns:
            made.append(table.selectExpr("coalesce(sum(octet_length(values)), 0)").first()[0])
        return table

    monkeypatch.setattr(shingles, "durable", durable)
    texts = [" ".join(f"t{i}w{k}" for k in range(400)) for i in range(40)]
    texts += [texts[0].replace("t0w200", "other"), "a b c d e f " * 3]
    nodes = [shingles.node_of(s) for s in shingles.shingle_sets(pa.array(texts))]
    docs = spark.createDataFrame([(t,) for t in texts], "__text string")
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(nodes) for b in nodes[:i]], "a long, b long")
    good = {(r.a, r.b) for r in shingles.verified(pairs, docs, 5, 0.8).collect()}
    assert good == {(min(nodes[0], nodes[40]), max(nodes[0], nodes[40]))}
    assert sum(made) < 41 * 396 * 8 / 4


def test_counts_bound_what_sets_share():
    rng = np.random.default_rng(6)
    for n, m, both in [(1, 1, 1), (5, 3, 0), (300, 260, 250), (520, 500, 450), (4000, 5000, 3900), (9000, 9000, 9)]:
        values = rng.integers(0, 1 << 63, size=n + m - both, dtype=np.uint64)
        x, y = values[:n], values[n - both :]
        most, total = shingles.shared_at_most(shingles.counts_of(x), shingles.counts_of(y))
        assert total == n + m and both <= most <= min(n, m)
        assert shingles.shared(np.sort(x).tobytes(), np.sort(y).tobytes()) == (both, n + m)
    assert shingles.counts_of(np.full(600, 8, dtype=np.uint64)) == b""


def test_fingerprints_in_bk_trees_link_first(spark, monkeypatch):
    """One changed word in 600 leaves a fingerprint within two bits: the BK-tree shards give
    the pair, and the search by shingles has nothing left to compare."""
    sent, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda pairs, *a: (sent.append(pairs.count()), verified(pairs, *a))[1])
    rows = []
    for g in range(20):
        words = [f"g{g}w{i}" for i in range(600)]
        pair = [" ".join(words), " ".join([*words[:-1], "changed"])]
        prints = [simhash.majority(s) for s in shingles.shingle_sets(pa.array(pair))]
        if (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS:
            rows += [(2 * g, pair[0]), (2 * g + 1, pair[1])]
    assert len(rows) >= 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.component_id == r.doc_id // 2 * 2 for r in shingles.near_duplicates(docs).collect())
    assert sent[0] == len(rows) // 2 and sum(sent[1:]) == 0


def test_large_groups_and_null_ids(spark, monkeypatch):
    """Groups above the bound are broadcast, the others are not; copies with and without ids."""
    monkeypatch.setattr(shingles, "placed", lambda rows, groups, total, f=shingles.placed: f(rows, groups, total, 10))
    rows = [(5 + i, "a b c d e f", "k") for i in range(30)] + [(None, "a b c d e f", "k"), (None, "p q", "k"), (None, "p q", "k"), (90, "x y", "k"), (91, "x y", "k"), (92, "alone here", "k"), (None, "no one", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    found = sorted(((r.text, r.doc_id or 0), r.component_id) for r in shingles.near_duplicates(docs).collect())
    want = {"a b c d e f": 5, "p q": None, "x y": 90, "alone here": 92, "no one": None}
    assert [c for _, c in found] == [want[t] for (t, _), _ in found] and len(found) == len(rows)
    assert sorted((r.text, r.doc_id or 0) for r in shingles.one_of_each(docs).collect()) == [("a b c d e f", 5), ("alone here", 92), ("no one", 0), ("p q", 0), ("p q", 0), ("x y", 90)]


def test_pipeline_stage_removes_near_copies(spark):
    """The changed copies share more than 0.8 of their shingles."""
    base = " ".join(f"word{i}" for i in range(120))
    copies = [base.replace("word60", "other"), base.replace("word20", "some").replace("word90", "more"), base + " and a tail"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([base, *copies, "another text that stays as it is"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 4}
