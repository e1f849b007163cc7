"""Folds in blocks equal folds from the start, and are cut into many tasks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleworks.functions import folds, frames
from candleworks.operators import structure
from candleworks.plans import features as job
from candleworks.sources import bars as source
from tests.test_candles import walk_bars


class Sum:
    """A fold that never forgets: every guess is wrong."""

    def __init__(self, key):
        self.key, self.total, self.known = key, 0, {}

    def begin(self, state):
        self.total, known = json.loads(state)
        self.known = dict(known)

    def state(self, at):
        return json.dumps([self.total, sorted((k, v) for k, v in self.known.items() if v >= at)])

    def step(self, row):
        at, event, value, until = row
        if not event:
            self.known[value] = until
            return []
        self.total += value
        return [(self.key, at, self.total, sum(v >= at for v in self.known.values()))]

    def end(self):
        return [(self.key, -1, self.total, 0)]


@pytest.mark.parametrize(("size", "halo"), [(7, 3), (50, 0), (16, 40), (10_000, 10)])
def test_any_blocks_give_the_rows_of_one_fold(spark, size, halo):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for key in ("a", "b", None):
        at = np.flatnonzero(rng.random(200) < (0.9 if key != "b" else 0.1)).tolist()
        values = rng.integers(-5, 9, size=len(at)).tolist()
        spans = [(int(a), int(a + rng.integers(0, 60)), 1000 + i) for i, a in enumerate(rng.integers(0, 200, size=12))]
        rows += [(key, a, a, 1, v, None) for a, v in zip(at, values, strict=True)]
        rows += [(key, a, b, 0, n, b) for a, b, n in spans]
        total = 0
        for a, v in zip(at, values, strict=True):
            total += v
            want.append((key, a, total, sum(s <= a <= e for s, e, _ in spans)))
        want.append((key, -1, total, 0))
    df = spark.createDataFrame(rows, "k string, at long, until long, event int, value long, end long").repartition(3)
    found = folds.in_blocks(df, ("k",), Sum, "k string, at long, total long, n long", size, halo, closes=True)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("size", "halo"), [(64, 0), (50, 90), (128, 500)])
def test_anchors_and_lines_do_not_depend_on_blocks(spark, size, halo):
    bars = source.kept(job.positioned(walk_bars(spark, ("A", "B"), n=700, seed=5)))
    pivot = source.kept(structure.pivots(structure.swings(bars)))
    whole = structure.anchors(pivot)
    assert sorted(map(str, structure.anchors(pivot, size=size, halo=halo).collect())) == sorted(map(str, whole.collect()))
    line = source.kept(structure.lines(structure.pairs(whole, bars), bars))
    rows = structure.active_lines(bars, line).collect()
    assert len(rows) > 300
    assert sorted(map(str, structure.active_lines(bars, line, size=size, halo=halo).collect())) == sorted(map(str, rows))


def test_lines_and_pivots_meet_bars_as_arrays(spark, monkeypatch):
    bars = source.kept(job.positioned(walk_bars(spark, ("A",), n=600, seed=3)))
    pivot, plan = structure.pivots(structure.swings(bars)), []
    found = structure.line_facts(structure.pairs(structure.anchors(pivot), bars), bars)
    for df in (pivot, found):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        plan += [x for x in text.splitlines() if "explode(sequence" in x]
    assert len(plan) == 2 and all(f"/ {structure.ARRAY}" in x or f"cast({structure.ARRAY}" in x or "__block" in x for x in plan)
    facts = sorted(map(str, found.collect()))
    monkeypatch.setattr(structure, "ARRAY", 32)
    again = structure.line_facts(structure.pairs(structure.anchors(structure.pivots(structure.swings(bars))), bars), bars)
    assert sorted(map(str, again.collect())) == facts and len(facts) > 20


def test_ordinals_with_nulls_and_both_joins(spark):
    rows = [(s, t, i) for i, (s, t) in enumerate([(None, 5), (None, None), ("a", None), ("a", 3), ("a", 1), ("", 2), ("b", 9)] + [("hot", t) for t in range(50)])]
    df = spark.createDataFrame(rows, "symbol string, t int, i int").withColumn("Datetime", F.timestamp_seconds("t")).repartition(4)
    want, last, k = {}, object(), 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0))
    for g, (s, _, i) in enumerate(order):
        k = k + 1 if s == last else 0
        want[i], last = (k, g), s
    for threshold in ("10m", "-1"):  # symbols are joined by broadcast or by shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        assert {r.i: (r.position, r.global_position) for r in frames.ordinals(df, whole=True).collect()} == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert frames.ordinals(df.limit(0), whole=True).count() == 0
    with pytest.raises(ValueError, match="128"):
        frames.chunks(df, 64)
