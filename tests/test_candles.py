"""Candle features, targets and structure: SQL, plain twins, properties, hand cases."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candleworks import oracles, queries
from candleworks.functions.frames import ordinals
from candleworks.operators import structure
from candleworks.operators.features import candle_features, in_chunks
from candleworks.operators.targets import targets
from candleworks.plans import features as job
from candleworks.sources import bars as source

SF = "/root/testdata/sf0.001"
RULES = structure.DEFAULT


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in ("events", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def equal(found, want):
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (found, want))
    assert len(a) == len(b)
    for c in columns:
        for x, y in zip(a[c], b[c], strict=True):
            assert (pd.isna(x) and pd.isna(y)) or x == y or (isinstance(x, float) and abs(x - y) < 2e-6 * max(1, abs(x))), (c, x, y)


def test_all_candle_columns_equal_sql(spark, con):
    columns = sorted({c for own in queries.CANDLES.values() for c in own})
    equal(queries.candle_query(*columns)(spark, SF).toPandas(), con.execute(oracles.candle_sql(*columns)).df())


@pytest.mark.parametrize(
    "name",
    ["crossings", "s01_read_bars", "s02_recent_bars", "s03_parse_times", "s05_round_prices", "j01_without_bars", "x01_ordinals", "c12_default_symbol", "m08_lines", "m09_usable_pairs", "a06_class_report", "a07_confusion", "a08_regression", "a10_diagnosis", "d01_split", "n02_payload", "halo_chunks"],
)
def test_query_equals_sql(spark, con, name):
    equal(queries.QUERIES[name](spark, SF).toPandas(), con.execute(oracles.ORACLES[name]).df())


def walk_bars(spark, symbols=("A", "B"), n=420, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for symbol in symbols:
        price = 1000.0
        for i in range(n):
            path = price + np.cumsum(rng.normal(0, 2.0, 5))
            o, c = round(float(path[0]), 2), round(float(path[-1]), 2)
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), o, round(float(path.max()), 2), round(float(path.min()), 2), c, int(rng.integers(1, 99)), symbol))
            price = float(path[-1])
    return spark.createDataFrame(rows, source.BARS)


# ---------------------------------------------------------------- plain twins


def twin(bars: pd.DataFrame, side: str):
    """Anchors and active lines of one symbol, bar by bar, from the written rules."""
    h, l, c = (bars[x].tolist() for x in ("High", "Low", "Close"))
    n, k = len(bars), RULES.pivot_window
    edge = l if side == "support" else [-x for x in h]
    anchors, retired, active, lines = [], set(), None, {}

    def quality(a, b):
        (p1, v1, s1), (p2, v2, s2) = a, b
        span, rest = p2 - p1, n - 1 - p2
        price_span = max(h[p1 : p2 + 1]) - min(l[p1 : p2 + 1])
        slope = (v2 - v1) / span
        steep = abs(slope) / max(abs(v2), 1e-9)
        if span < RULES.min_span or rest < RULES.min_persistence or price_span <= 0 or steep > RULES.max_slope or abs(slope) > price_span / span:
            return None
        if abs(v2 - v1) / price_span > RULES.max_vertical:
            return None
        touch = reject = violate = 0
        for p in range(p1, p2 + 1):
            line, tol = v2 + slope * (p - p2), c[p] * RULES.tolerance
            near = abs((l if side == "support" else h)[p] - line) <= tol
            touch += near
            reject += near and (c[p] > line if side == "support" else c[p] < line)
            violate += c[p] < line - tol if side == "support" else c[p] > line + tol
        if touch < 2 or reject < 2 or violate / span > 0.25 or s1 + s2 < RULES.min_structure:
            return None
        bonus = 35.0 if (slope > 0 if side == "support" else slope < 0) else 0.0
        return min(span, 220) * 2.5 + touch * 22 + reject * 18 + min(rest, 120) * 0.6 + (s1 + s2) * 30 + bonus - steep * 14000 - abs(v2 - v1) / price_span * 45 - violate * 8

    for at in range(n):
        p = at - k
        if p >= k and all(edge[p] < edge[p + d] for d in range(-k, k + 1) if d) and not (anchors and p - anchors[-1][0] < RULES.min_pivot_distance):
            strength = (min(edge[p + d] for d in range(-k, k + 1) if d) - edge[p]) / max(abs(c[p]), 1e-9)
            ranges = [h[i] - l[i] for i in range(max(0, p - 20), p + 1)]
            volatility = max(sum(ranges) / len(ranges) / max(abs(c[p]), 1e-9), 1e-9)
            around = range(max(0, p - 24), min(n - 1, p + 24) + 1)
            rejections = sum(abs(edge[i] - edge[p]) <= c[p] * RULES.tolerance and (c[i] > l[i] if side == "support" else c[i] < h[i]) for i in around)
            apart = min((p - anchors[-1][0]) / 16, 2.5) if anchors else 1.0
            score = strength / volatility * 0.75 + min(rejections, 5) * 0.18 + apart * 0.25
            if score >= RULES.pivot_strength:
                anchors.append((p, abs(edge[p]), score))
        best = None
        usable = [a for a in anchors if anchors[-1][0] - a[0] <= RULES.lookback]
        for j in range(len(usable) - 1, 0, -1):
            for i in range(j - 1, -1, -1):
                key = (usable[i][0], usable[j][0])
                s = None if key in retired else quality(usable[i], usable[j])
                if s is not None and (best is None or s > best[0]):
                    best = (s, usable[i], usable[j], key)
        if best and (active is None or (best[3] != active["key"] and best[0] > active["score"] * 1.18)):
            active = {"a": best[1], "b": best[2], "key": best[3], "base": best[0], "score": best[0], "t": 0, "r": 0, "x": 0, "born": at, "last": at}
        if active:
            (p1, v1, _), (p2, v2, _) = active["a"], active["b"]
            line, tol = v2 + (v2 - v1) / (p2 - p1) * (at - p2), c[at] * RULES.tolerance
            near = abs((l if side == "support" else h)[at] - line) <= tol
            if near:
                active["t"] += 1
                active["last"] = at
                active["r"] += c[at] > line if side == "support" else c[at] < line
            active["x"] = active["x"] + 1 if (c[at] < line - tol if side == "support" else c[at] > line + tol) else 0
            idle = at - active["last"]
            active["score"] = active["base"] + active["t"] * 18 + active["r"] * 24 + min(at - active["born"], 160) * 0.35 + max(24 - idle, 0) * 2 - max(idle - 24, 0) * 4 - active["x"] * 55
            lines[at] = (line, p1, p2)
            if active["x"] >= 2 or idle > 48 or active["score"] < 30:
                retired.add(active["key"])
                active = None
    return anchors, lines


@pytest.mark.parametrize("seed", [0, 1])
def test_anchors_and_lines_equal_a_plain_fold(spark, seed):
    bars = source.kept(job.positioned(walk_bars(spark, seed=seed)))
    anchor = source.kept(structure.anchors(structure.pivots(structure.swings(bars))))
    active = structure.active_lines(bars, structure.lines(structure.pairs(anchor, bars), bars)).toPandas()
    anchors = anchor.toPandas()
    wide = job.structured(bars).toPandas().set_index(["symbol", "position"])
    some = 0
    for symbol, own in bars.toPandas().groupby("symbol"):
        own = own.sort_values("position")
        for side in structure.SIDES:
            want_anchors, want_lines = twin(own, side)
            got = anchors[(anchors.symbol == symbol) & (anchors.side == side)].sort_values("position")
            assert got.position.tolist() == [a[0] for a in want_anchors] and np.allclose(got.score, [a[2] for a in want_anchors])
            got = active[(active.symbol == symbol) & (active.side == side)].sort_values("position")
            assert got.position.tolist() == sorted(want_lines)
            assert np.allclose(got.line, [want_lines[p][0] for p in got.position])
            assert list(zip(got.first_pos, got.second_pos, strict=True)) == [want_lines[p][1:] for p in got.position]
            some += len(want_lines)
            column = wide.loc[symbol][f"anchored_{side}"]
            assert column.notna().sum() == len(want_lines)
        one = wide.loc[symbol].sort_index()
        beyond = (one.Close > one.anchored_resistance).astype(int)
        assert one.anchored_breakout.tolist() == [int(i > 0 and beyond.iloc[i] and beyond.iloc[i - 1]) for i in range(len(one))]
    assert some > 100


# ---------------------------------------------------------------- properties and hand cases


def test_chunks_equal_whole_symbols(spark):
    bars = ordinals(walk_bars(spark, n=700))
    apply = lambda b, keys: targets(structure.swings(candle_features(b, keys), keys), keys)
    a = apply(bars, ("symbol",)).toPandas()
    b = in_chunks(bars, apply, 256).select(*a.columns).toPandas()
    equal(a, b)


def test_warm_up_is_null_and_flags_are_not(spark):
    table = job.all_columns(walk_bars(spark, n=150)).toPandas().sort_values(["symbol", "position"])
    for column, first in {"return_1": 1, "momentum": 8, "volatility": 10, "atr_14": 13, "avg_volume": 19, "adx_14": 26, "ma_50": 49, "trend_slope_100": 99}.items():
        for _, own in table.groupby("symbol"):
            assert own[column].isna().sum() == first and own[column].iloc[first:].notna().all(), column
    for column in ("trending_market", "high_volatility_market", "swing_high", "anchored_breakout", "bullish_cross_50_100", "failed_breakdown", "target_d"):
        assert table[column].notna().all()


def test_symbols_do_not_mix(spark):
    both, one = walk_bars(spark), walk_bars(spark, ("A",))
    renamed = both.withColumn("symbol", F.when(F.col("symbol") == "A", "zz").otherwise("aa")).repartition(5)
    columns = ["position", "return_1", "adx_14", "anchored_support", "target_d"]
    a = job.all_columns(renamed).where("symbol = 'zz'").select(*columns).toPandas()
    equal(a, job.all_columns(one).select(*columns).toPandas())


def test_mirrored_prices_mirror_targets(spark):
    bars = walk_bars(spark, ("A",), n=100)
    mirror = bars.select("Datetime", *[(2000 - F.col(c)).alias(n) for c, n in (("Open", "Open"), ("Low", "High"), ("High", "Low"), ("Close", "Close"))], "Volume", "symbol")
    a, b = (targets(x).orderBy("Datetime").toPandas() for x in (bars, mirror))
    moves = a.future_max_high - a.Close, a.Close - a.future_min_low
    sure = (abs(moves[0] - moves[1]) > 1) & (np.maximum(*moves) > 8)
    assert ((a.target_d + b.target_d)[sure] == 2).all() and sure.sum() > 20


def test_flat_short_and_single(spark):
    flat = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0, "F") for i in range(130)], source.BARS)
    table = job.all_columns(flat)
    row = table.where("position = 120").first()
    assert row.return_1 == 0 and row.volume_spike is None and row.adx_14 == 0 and row.volatility_expansion is None and row.swing_high == 0
    assert table.agg(F.sum("swing_high"), F.sum("swing_low")).first() == (0, 0)
    assert job.feature_table(flat).count() == 0
    assert job.feature_table(flat.limit(5)).count() == 0
    with pytest.raises(ValueError, match="no bars"):
        job.all_columns(flat.limit(0))
    with pytest.raises(ValueError, match="repeat"):
        job.all_columns(flat.union(flat.limit(1)))
    tie = [(10, 9), (11, 9), (12, 9), (13, 9), (13, 9), (12, 9), (11, 9), (10, 9)]
    ties = spark.createDataFrame([(dt.datetime(2024, 1, 1, i), float(h), float(h), float(l), float(l), 1, "T") for i, (h, l) in enumerate(tie)], source.BARS)
    assert structure.swings(job.positioned(ties)).agg(F.sum("swing_high")).first()[0] == 0


def test_ties_between_lines_go_to_the_later_anchors():
    pairs = [(0, 40, 100.0), (5, 40, 100.0), (5, 41, 100.0), (7, 41, 99.0)]

    def follow(close):
        state, found = structure.Follower("s", "support", RULES), []
        for at in range(100):
            for first, second, score in pairs:
                if second + 3 == at:
                    found += state.step((at, 0, None, None, None, first, 10.0, second, 10.0, score, None))
            found += state.step((at, 1, 10.0, 11.0, close(at), *[None] * 6))
        return [(r[2], r[4], r[6]) for r in found]

    found = follow(lambda at: 10.5)
    assert found[0] == (43, 5, 40)
    found = follow(lambda at: 10.5 if at < 60 else 9.0)
    assert found[0] == (43, 5, 40) and next(f for f in found if f[0] > 61)[1:] == (5, 41)


def test_follower_forgets_what_is_stale():
    """The heap stays small over a long history, and keeps the best usable pair."""
    state = structure.Follower("s", "resistance", RULES)
    for at in range(0, 60_000):
        state.step((at + 3, 0, None, None, None, at, 10.0, at + 1, 10.0, float(at % 97), at + 50))
        state.step((at + 3, 1, 1.0, 5.0, 4.0, *[None] * 6))
    assert len(state.heap) <= 1026 and len(state.retired) <= 1026


def test_source_checks(spark):
    bars = walk_bars(spark, n=3)
    with pytest.raises(ValueError, match="Close"):
        source.select_bars(bars.drop("Close"))
    with pytest.raises(ValueError):
        source.unique_times(bars.union(bars))
    with pytest.raises(ValueError):
        source.not_empty(bars.limit(0))
    with pytest.raises(ValueError):
        source.stack([])
    assert source.unique_times(bars).count() == 6
    assert source.flatten_names(bars.toDF(*[f"{c}/A" for c in bars.columns])).columns == bars.columns
