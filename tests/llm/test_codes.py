"""Vector codes and the tree over entries against brute force."""

import hashlib
import math

import numpy as np
import pytest

from candleworks.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, key string, n int"


@pytest.mark.parametrize("degree", [2, 3, 4, 20])
@pytest.mark.parametrize("spread", [2, 50, 1 << 24])
def test_tree_finds_the_nearest_and_lowest(degree, spread):
    rng = np.random.default_rng(degree * 1000 + spread)
    for n in (1, 2, 5, 16, 60):
        entries = rng.integers(-spread, spread + 1, size=(n, 3))
        entries[n // 2] = entries[0]
        x = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, size=(400, 3)), entries, (entries[:1] + entries[-1:]) // 2])
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        at, best = codes.Gnat(entries, degree).nearest(x)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert len(codes.Gnat(entries, degree).nearest(x[:0])[0]) == 0


def test_tree_leaves_out_subtrees():
    """Far clusters are not visited, so some of the pruning happens."""
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(0, 50, size=(8, 4)) + 10_000 * k for k in range(4)])
    tree, seen = codes.Gnat(entries, 4), []
    counted = tree.entries

    class Watched:
        def __getitem__(self, which):
            seen.append(len(which))
            return counted[which]

        def __len__(self):
            return len(counted)

    tree.entries = Watched()
    assert (tree.nearest(entries[:1])[1] == 0).all()
    assert sum(seen) < len(entries)


def brute(rows, parts=8, entries=16, rounds=6):
    """Python integers only: {row number: (code, error)}, label sums, digest."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = {i: [math.floor(4096 * x) for x in r[1]] for i, r in kept}
    w = len(next(iter(ints.values()))) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    first = sorted(kept, key=lambda t: (t[1][0] is None, t[1][0] or 0))[:entries]
    books = [[cut(ints[i], p) for i, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((dist(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = {}
            for v in ints.values():
                groups.setdefault(nearest(v, p)[1], []).append(cut(v, p))
            for k, g in groups.items():
                new[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
        books = new
    out, labels = {}, {}
    for i, r in kept:
        found = [nearest(ints[i], p) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
        labels[r[2]] = labels.get(r[2], 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, labels, digest


def table(n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 3)
    x[n // 2] = x[0]
    return [(int(i), [float(v) for v in row], None if i % 3 == 0 else int(i % 5), "old", "k", 1) for i, row in enumerate(x)]


@pytest.mark.parametrize("many", [True, False])
def test_codes_are_those_of_plain_integers(spark, monkeypatch, many):
    rows = table(150)
    rows += [(900, None, 1, "old", "k", 1), (901, [], 1, "old", "k", 1), (902, [float("nan")] + [1.0] * 15, 1, "old", "k", 1), (903, [None] + [1.0] * 15, 1, "old", "k", 1), (904, [float("-inf")] + [1.0] * 15, 1, "old", "k", 1)]
    rows += [(3, *rows[3][1:]), (3, *rows[3][1:]), (905, [16_000.0, -16_000.5] * 8, None, "old", "k", 1)]
    if not many:
        monkeypatch.setattr(codes, "MANY", 0)
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want, labels, digest = brute(rows)
    assert books.digest() == digest
    assert found.columns == ["vec_id", "embedding", "label", "key", "n", "code", "error", "label_error"]
    got = sorted((r.vec_id, r.code, r.error, r.label_error, r.key, r.n) for r in found.collect())
    assert got == sorted((rows[i][0], c, e, labels[rows[i][2]], "k", 1) for i, (c, e) in want.items())


def test_few_and_no_vectors(spark):
    rows = table(5, width=8)
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    want, _, digest = brute(rows)
    assert books.digest() == digest and {r.vec_id: (r.code, r.error) for r in found.collect()} == want
    for none in ([], [(1, None, 1, "x", "k", 1)]):
        found, books = codes.compress(spark.createDataFrame(none, SCHEMA))
        assert books is None and found.count() == 0 and found.columns[-3:] == ["code", "error", "label_error"]


def test_null_ids_come_last(spark):
    rows = table(20, width=8)
    rows = [(None, *r[1:]) if r[0] < 2 else r for r in rows]
    books = codes.compress(spark.createDataFrame(rows, SCHEMA), rounds=0)[1]
    assert books.entries[0][:, 0].tolist() == [math.floor(4096 * r[1][0]) for r in rows[2:18]]


@pytest.mark.parametrize("bad", [[1.0] * 15, [1.0] * 8, [16_384.0] * 16])
def test_vectors_that_do_not_fit_are_refused(spark, bad):
    rows = [*table(4), (77, bad, 1, "x", "k", 1)] if len(bad) != 15 else [(77, bad, 1, "x", "k", 1)]
    with pytest.raises(Exception, match="widths|equal parts|below"):
        codes.compress(spark.createDataFrame(rows, SCHEMA).coalesce(1))
