"""Registered queries do the whole job of their operators."""

import json

from pyspark.sql import functions as F

from candleworks import queries
from candleworks.operators import model

SF = "/root/testdata/sf0.001"


def test_trained_queries_use_all_trees_and_features(spark, monkeypatch):
    """With one tree for the test's sake: what the queries ask for is the default."""
    asked, fit = [], model.fit

    def short(train, features, **changes):
        asked.append(model.TREES | changes)
        return fit(train, features, **(changes | {"maxIter": 1}))

    monkeypatch.setattr(model, "fit", short)
    assert queries.QUERIES["d06_importances"](spark, SF).count() == 44
    assert asked == [model.TREES] and model.TREES["maxIter"] == 100


def test_sets_of_bars_hold_every_symbol(spark):
    whole = sorted(map(tuple, queries.QUERIES["s02_bars_from_ticks"](spark, SF).collect()))
    for name in ("u01_stack", "u01_stack_all", "s07_flatten_names", "s07_flatten_all_names"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, SF).collect())) == whole
    tagged = queries.QUERIES["s06_tag_all"](spark, SF).collect()
    assert len(tagged) == len(whole) and {r.symbol for r in tagged} == {"ALL.X"}


def test_payload_holds_its_records(spark):
    bars = {r.symbol: r.n for r in queries.QUERIES["s02_bars_from_ticks"](spark, SF).groupBy("symbol").agg(F.count("*").alias("n")).collect()}
    rows = queries.QUERIES["n02_payload_json"](spark, SF).collect()
    held = {}
    for r in rows:
        held[r.symbol] = held.get(r.symbol, 0) + r.n_rows
        assert len(json.loads(r.json)) == r.n_rows <= 500
    assert held == bars
