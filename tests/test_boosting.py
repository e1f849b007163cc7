"""Trees that are grown in jobs against a plain, row-by-row twin."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleworks.operators import boosting

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 5)), 2)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=400) > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    target = x[:, 2] * 0.1 + np.where(y == 2, 0.05, 0.0)
    rows = [("s", i, *map(float, r), int(k), float(t), "train" if i < 350 else "test") for i, (r, k, t) in enumerate(zip(x, y, target, strict=True))]
    return spark.createDataFrame(rows, "symbol string, position long, " + ", ".join(f"{c} double" for c in FEATURES) + ", target_d int, target_p double, part string").withColumn("Datetime", F.timestamp_seconds("position"))


def plain_trees(rows, keys, edges, options, classes=3):
    """Row by row, with dictionaries of sums: the rounds as lists of (feature, cut, value)."""
    n, outputs = len(rows), classes + 1
    of = {k: sum(r.target_d == k for r in rows) for k in {r.target_d for r in rows}}
    weight = [n / (len(of) * of[r.target_d]) for r in rows]
    bins = [[sum(r[c] > e for e in edges[j]) for j, c in enumerate(FEATURES)] for r in rows]
    scale = 2.0 ** min(36, 61 - math.ceil(math.log2(n * max(1.0, max(weight)) + 1)))
    margins = [[0.0] * outputs for _ in rows]
    out = []
    for number in range(options.trees):
        use = [bool(u) for u in boosting.drawn_rows(np.array(keys, dtype=np.int64), number, options)]
        grad = []
        for i, r in enumerate(rows):
            top = max(margins[i][:classes])
            e = [math.exp(m - top) for m in margins[i][:classes]]
            p = [v / sum(e) for v in e]
            one = [(round((p[k] - (r.target_d == k)) * weight[i] * scale), round(max(2 * p[k] * (1 - p[k]), 1e-16) * weight[i] * scale)) for k in range(classes)]
            grad.append([*one, (round((margins[i][classes] - r.target_p) * scale), round(scale))])
        trees = []
        for k in range(outputs):
            allowed = boosting.drawn_features(len(FEATURES), number, k, options).tolist()
            splits, value = {}, {}
            groups = {0: [i for i in range(n) if use[i]]}
            for level in range(options.depth):
                for node in [x for x in groups if 2**level - 1 <= x < 2 ** (level + 1) - 1]:
                    own = groups[node]
                    g, h = (sum(grad[i][k][w] for i in own) / scale for w in (0, 1))
                    if node == 0:
                        value[0] = -options.rate * g / (h + options.penalty)
                    best = None
                    for f in allowed:
                        for cut in range(options.bins - 1):
                            lg, lh = (sum(grad[i][k][w] for i in own if bins[i][f] <= cut) / scale for w in (0, 1))
                            rg, rh = g - lg, h - lh
                            if lh < options.least_hessian or rh < options.least_hessian:
                                continue
                            score = lambda a, b: a * a / (b + options.penalty)
                            gain = score(lg, lh) + score(rg, rh) - score(g, h)
                            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, cut, lg, lh, rg, rh)
                    if best:
                        splits[node] = best[1:3]
                        for side, (a, b) in enumerate((best[3:5], best[5:7])):
                            value[2 * node + 1 + side] = -options.rate * a / (b + options.penalty)
                            groups[2 * node + 1 + side] = [i for i in own if (bins[i][best[1]] > best[2]) == bool(side)]
            trees.append((splits, value))
            for i in range(n):
                node = 0
                while node in splits:
                    f, cut = splits[node]
                    node = 2 * node + 1 + (bins[i][f] > cut)
                margins[i][k] += value[node]
        out.append(trees)
    return out, margins


def test_trees_equal_a_plain_twin(spark, table):
    """Splits and leaves, however the rows are dealt and the margins are written."""
    train = table.where("part = 'train'")
    rows = train.withColumn("key", F.xxhash64("symbol", "position")).orderBy("position").collect()
    changes = {"trees": 4, "rate": 0.3, "bins": 8, "row_share": 0.7, "feature_share": 0.8}
    models = [boosting.fit(train.repartition(n), FEATURES, **changes, every=every, rows_a_task=t) for n, every, t in ((1, 25, 1000), (5, 2, 60))]
    options = models[0].options
    want, margins = plain_trees(rows, [r.key for r in rows], models[0].edges, options)
    for model in models:
        for number, trees in enumerate(want):
            r = model.rounds[number]
            for k, (splits, value) in enumerate(trees):
                assert {i: (int(r.feature[k, i]), int(r.cut[k, i])) for i in range(7) if r.feature[k, i] >= 0} == splits, (number, k)
                leaves = {n for n in value if n not in splits}
                assert all(r.value[k, i] == pytest.approx(value[i], rel=1e-6) for i in leaves)
        x = np.array([[row[c] for c in FEATURES] for row in rows])
        assert np.allclose(model.margins(model.binned(x)), margins)


def test_predictions_are_softmax_of_the_margins(spark, table):
    model = boosting.fit(table.where("part = 'train'"), FEATURES, trees=25, rate=0.3, row_share=0.8, feature_share=1.0)
    found = {r.position: r for r in boosting.predict(model, table).collect()}
    rows = table.collect()
    x = np.array([[r[c] for c in FEATURES] for r in rows])
    margins = model.margins(model.binned(x))
    for r, m in zip(rows, margins, strict=True):
        p = np.exp(m[:3]) / np.exp(m[:3]).sum()
        got = found[r.position]
        assert got.predicted_d == p.argmax() and got.confidence == pytest.approx(p.max()) and got.predicted_p == pytest.approx(m[3])
        assert (got.actual_d, got.actual_p, got.part) == (r.target_d, r.target_p, r.part)
    hit = [found[r.position].predicted_d == r.target_d for r in rows if r.part == "test"]
    assert sum(hit) / len(hit) > 0.8
    error = [abs(found[r.position].predicted_p - r.target_p) for r in rows if r.part == "test"]
    assert np.mean(error) < 0.5 * np.mean([abs(r.target_p) for r in rows])
    share = {r.feature: r.importance for r in boosting.importances(model, spark).collect()}
    assert sum(share.values()) == pytest.approx(1) and max(share, key=share.get) in ("a", "b") and share["e"] < share["a"]
    with pytest.raises(ValueError):
        boosting.fit(table.limit(0), FEATURES)


def test_quantiles_and_missing_values(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else 1.0) for i in range(100)], "a double, b double")
    edges = boosting.quantiles(df, ["a", "b"], 4)
    assert edges[0].tolist() == [24.0, 49.0, 74.0] and edges[1].tolist() == [1.0]
    model = boosting.Boosted(["a", "b"], edges, 3, [], boosting.Options())
    assert model.binned(np.array([[24.0, 1.0], [24.5, 2.0], [99.0, math.nan]])).tolist() == [[0, 0], [1, 1], [3, 1]]
