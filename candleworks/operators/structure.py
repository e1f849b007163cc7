"""Market structure: swings, anchors, trendlines, breakouts.

Swings, pivot terms, pairs of anchors and the facts of every line are windows, joins
and groupings. Pivots and lines meet the bars around them as arrays, one for each block of
positions. Two ordered folds remain, the greedy choice of anchors and the line that is
active at each bar: blocks of a symbol are folded side by side (`functions.folds`).
"""

from __future__ import annotations

import heapq
import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import div, flag
from ..functions.folds import in_blocks
from ..functions.frames import Frames


@dataclass(frozen=True)
class Rules:
    """Parameters of the structure. They are the feature job's."""

    pivot_window: int = 3
    confirmation: int = 2
    min_pivot_distance: int = 10
    max_slope: float = 0.0022
    pivot_strength: float = 0.85
    min_span: int = 28
    separation_unit: int = 16
    min_touches: int = 2
    tolerance: float = 0.0035
    lookback: int = 180
    min_persistence: int = 12
    max_vertical: float = 0.65
    max_violations: float = 0.25
    min_structure: float = 0.85
    max_untouched: int = 48
    max_breaks: int = 2
    min_active: float = 30.0
    replacement: float = 1.18
    recent: int = 24
    rejection_window: int = 24
    volatility_window: int = 20


DEFAULT = Rules()
SIDES = ("support", "resistance")


def swings(bars: DataFrame, keys=("symbol",), rules: Rules = DEFAULT) -> DataFrame:
    """bars with swing_high and swing_low (beyond each of k bars on both sides),
    high_strength and low_strength (gap to the best of those, over the close) and
    local_volatility (mean range of up to 21 bars, over the close)."""
    f, k = Frames(keys), rules.pivot_window
    h, l = F.col("High"), F.col("Low")
    before, after = f.rows(-k, -1), f.rows(1, k)
    full = (F.count(h).over(before) == k) & (F.count(h).over(after) == k) & (F.count(l).over(before) == k) & (F.count(l).over(after) == k)
    top = F.greatest(F.max(h).over(before), F.max(h).over(after))
    bottom = F.least(F.min(l).over(before), F.min(l).over(after))
    close = F.greatest(F.abs("Close"), F.lit(1e-9))
    return bars.withColumns(
        {
            "swing_high": flag(full & (h > top)),
            "swing_low": flag(full & (l < bottom)),
            "high_strength": (h - top) / close,
            "low_strength": (bottom - l) / close,
            "local_volatility": F.avg(h - l).over(f.rows(-rules.volatility_window, 0)) / close,
        }
    )


def pivots(marked: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """One row for each swing and side: its price and the parts of its score that do
    not depend on other anchors. Nearby rejections are counted in the blocks of bars that
    the swing's neighbourhood meets."""
    sides = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("swing_low") == 1, F.struct(F.lit("support").alias("side"), F.col("Low").alias("price"), F.col("low_strength").alias("strength"))),
                F.when(F.col("swing_high") == 1, F.struct(F.lit("resistance").alias("side"), F.col("High").alias("price"), F.col("high_strength").alias("strength"))),
            )
        )
    ).alias("s")
    found = marked.where("swing_low = 1 or swing_high = 1").select("symbol", "position", F.col("Close").alias("pivot_close"), "local_volatility", sides)
    found = found.select("symbol", "position", "pivot_close", "local_volatility", "s.*")
    n = rules.rejection_window
    support = F.col("side") == "support"

    def rejected(bar: Column) -> Column:
        extreme = F.when(support, bar["Low"]).otherwise(bar["High"])
        turned = F.when(support, bar["Close"] > bar["Low"]).otherwise(bar["Close"] < bar["High"])
        return (F.abs(extreme - F.col("price")) <= F.col("pivot_close") * rules.tolerance) & turned

    met = beside(found.withColumns({"from": F.greatest(F.col("position") - n, F.lit(0)), "to": F.col("position") + n}), marked)
    counts = met.groupBy("symbol", "side", "position").agg(F.sum(F.size(F.filter("bars", rejected)).cast("long")).alias("rejections"))
    base = F.col("strength") / F.greatest("local_volatility", F.lit(1e-9)) * 0.75 + F.least("rejections", F.lit(5)) * 0.18
    return found.join(counts, ["symbol", "side", "position"]).select("symbol", "side", "position", "price", "strength", "local_volatility", "rejections", base.alias("base"))


KEYS = ("symbol", "side")
#: Bars of an array, and of a block that is folded in one go with those before it where
#: the fold begins.
ARRAY, BLOCK, HALO = 256, 4096, 1024
ANCHOR_COLUMNS = "symbol string, side string, position long, price double, score double, stale long"


def beside(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """spans (symbol, from, to: positions) with `bars`, the array of the bars in them, in a
    row for each block that they meet: one or two, as long as they are shorter than that.
    Bars are gathered once, in arrays of a block's bars."""
    block = lambda c: F.floor(F.col(c) / ARRAY).cast("long")
    arrays = bars.groupBy("symbol", block("position").alias("__block")).agg(F.collect_list(F.struct("position", "High", "Low", "Close")).alias("bars"))
    met = spans.withColumn("__block", F.explode(F.sequence(block("from"), block("to")))).join(arrays, ["symbol", "__block"])
    return met.withColumn("bars", F.filter("bars", lambda b: b["position"].between(F.col("from"), F.col("to")))).drop("__block", "from", "to")


class Chooser:
    """Which swings of one symbol and side become anchors. An anchor is given out once
    it is known when it gets stale: as a later one lies more than lookback beyond it."""

    def __init__(self, symbol: str, side: str, rules: Rules):
        self.key, self.rules, self.last, self.open = (symbol, side), rules, None, deque()

    def begin(self, state: str) -> None:
        self.last, anchors = json.loads(state)
        self.open = deque(map(tuple, anchors))

    def state(self, at: int) -> str:
        return json.dumps([self.last, list(self.open)])

    def step(self, row: tuple) -> list[tuple]:
        (position, _, price, base), rules = row, self.rules
        if self.last is not None and position - self.last < rules.min_pivot_distance:
            return []
        separation = 1.0 if self.last is None else min((position - self.last) / max(rules.separation_unit, 1), 2.5)
        score = 0.0 if base is None or base != base else base + separation * 0.25
        if score < rules.pivot_strength:
            return []
        self.last, done = position, []
        while self.open and self.open[0][0] < position - rules.lookback:
            done.append((*self.key, *self.open.popleft(), position + rules.pivot_window))
        self.open.append((position, price, score))
        return done

    def end(self) -> list[tuple]:
        return [(*self.key, *anchor, None) for anchor in self.open]


def anchors(pivot: DataFrame, rules: Rules = DEFAULT, size: int = BLOCK, halo: int = HALO) -> DataFrame:
    """(symbol, side, position, price, score, stale) of the anchors; known `pivot_window`
    bars after their position. stale is the bar from which an anchor is not a line's
    first any more: when one is known that lies more than `lookback` beyond it. Any block
    size and halo give the same rows."""
    at = F.col("position")
    rows = pivot.select(*KEYS, at.alias("at"), at.alias("until"), F.lit(1).alias("event"), "price", "base")
    return in_blocks(rows, KEYS, lambda symbol, side: Chooser(symbol, side, rules), ANCHOR_COLUMNS, size, halo, closes=True)


def projected(p1: Column, v1: Column, p2: Column, v2: Column, at: Column) -> Column:
    """Value at a position of the line through two anchors; null if they share theirs."""
    return F.when(p1 != p2, v2 + (v2 - v1) / (p2 - p1) * (at - p2))


def pairs(anchor: DataFrame, bars: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Pairs of anchors that pass the rules which need no bars, with the bars at which
    they can be used: from the second's confirmation until an anchor is confirmed that
    lies more than `lookback` beyond the first."""
    w = Window.partitionBy("symbol", "side").orderBy("position")
    # what ends the use of a pair is a matter of its first anchor
    firsts = F.collect_list(F.struct("position", "price", "score", "stale")).over(w.rangeBetween(-rules.lookback, -rules.min_span))
    last = bars.groupBy("symbol").agg(F.max("position").alias("last_pos"))
    found = anchor.withColumn("firsts", firsts).select("symbol", "side", F.explode("firsts").alias("f"), F.col("position").alias("second_pos"), F.col("price").alias("second_price"), F.col("score").alias("second_score"))
    found = found.select("symbol", "side", F.col("f.position").alias("first_pos"), F.col("f.price").alias("first_price"), F.col("f.score").alias("first_score"), "second_pos", "second_price", "second_score", F.col("f.stale").alias("stale"))
    slope = (F.col("second_price") - F.col("first_price")) / (F.col("second_pos") - F.col("first_pos"))
    found = found.join(last, "symbol").withColumns(
        {
            "span": F.col("second_pos") - F.col("first_pos"),
            "persistence": F.col("last_pos") - F.col("second_pos"),
            "slope": slope,
            "normalized_slope": F.abs(slope) / F.greatest(F.abs("second_price"), F.lit(1e-9)),
            "usable_from": F.col("second_pos") + rules.pivot_window,
        }
    )
    return found.where((F.col("persistence") >= rules.min_persistence) & (F.col("normalized_slope") <= rules.max_slope) & (F.col("first_score") + F.col("second_score") >= rules.min_structure))


def line_facts(pair: DataFrame, bars: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """pair with price_span, touches, rejections and body_violations over the bars from
    the first to the second anchor: each line meets the one or two blocks of bars it
    crosses, and the parts are added up."""
    key = ["symbol", "side", "first_pos", "second_pos"]
    spans = pair.select(*key, "first_price", "second_price", F.col("first_pos").alias("from"), F.col("second_pos").alias("to"))
    support = F.col("side") == "support"

    def seen(bar: Column) -> Column:
        """How the line lies at a bar: touched, rejected, violated."""
        c, tolerance = bar["Close"], bar["Close"] * rules.tolerance
        line = projected(F.col("first_pos"), F.col("first_price"), F.col("second_pos"), F.col("second_price"), bar["position"])
        touched = F.abs(F.when(support, bar["Low"]).otherwise(bar["High"]) - line) <= tolerance
        rejected = touched & F.when(support, c > line).otherwise(c < line)
        violated = F.when(support, c < line - tolerance).otherwise(c > line + tolerance)
        return F.struct(bar["High"].alias("high"), bar["Low"].alias("low"), flag(touched).alias("touched"), flag(rejected).alias("rejected"), flag(violated).alias("violated"))

    met = beside(spans, bars).select(*key, F.transform("bars", seen).alias("seen"))
    total = lambda name: F.sum(F.aggregate(F.col(f"seen.{name}"), F.lit(0).cast("long"), lambda a, x: a + x))
    facts = met.groupBy(*key).agg(
        (F.max(F.array_max("seen.high")) - F.min(F.array_min("seen.low"))).alias("price_span"),
        total("touched").alias("touches"),
        total("rejected").alias("rejections"),
        total("violated").alias("body_violations"),
    )
    return pair.join(facts, key)


def lines(pair: DataFrame, bars: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Pairs that pass all rules, with their score, a constant of the series."""
    found = line_facts(pair, bars, rules)
    rise = F.abs(F.col("second_price") - F.col("first_price"))
    vertical = div(rise, F.col("price_span"))
    good = (
        (F.col("price_span") > 0)
        & (F.abs("slope") <= F.col("price_span") / F.col("span"))
        & (vertical <= rules.max_vertical)
        & (F.col("touches") >= rules.min_touches)
        & (F.col("rejections") >= rules.min_touches)
        & (F.col("body_violations") / F.col("span") <= rules.max_violations)
    )
    favoured = ((F.col("side") == "support") & (F.col("slope") > 0)) | ((F.col("side") == "resistance") & (F.col("slope") < 0))
    score = (
        F.least("span", F.lit(220)) * 2.5
        + (F.col("touches") * 22.0 + F.col("rejections") * 18.0)
        + F.least("persistence", F.lit(120)) * 0.6
        + (F.col("first_score") + F.col("second_score")) * 30.0
        + F.when(favoured, 35.0).otherwise(0.0)
        - (F.col("normalized_slope") * 14000.0 + vertical * 45.0)
        - F.col("body_violations") * 8.0
    )
    return found.where(good).withColumn("score", score)


LINE_COLUMNS = "symbol string, side string, position long, line double, first_pos long, first_price double, second_pos long, second_price double"


class Follower:
    """The active line of one symbol and side. Pairs come before the bar from which they
    can be used and wait in a heap, best first (ties to the later second anchor, then
    first); a stale or retired one goes when it comes to the top, or when the heap has
    doubled since it was last cleared."""

    def __init__(self, symbol: str, side: str, rules: Rules):
        self.key, self.rules, self.up = (symbol, side), rules, 1 if side == "support" else -1
        self.heap: list[tuple] = []
        self.retired: dict[tuple, int | None] = {}  # and when they get stale
        self.room, self.active = 1024, None

    def begin(self, state: str) -> None:
        self.active, retired = json.loads(state)
        self.retired = {(first, second): stale for first, second, stale in retired}
        if self.active:
            self.active |= {k: tuple(self.active[k]) for k in ("key", "line")}

    def state(self, at: int) -> str:
        """The active line, and the retired pairs that would still be usable."""
        retired = sorted((*key, stale) for key, stale in self.retired.items() if stale is None or at < stale)
        return json.dumps([self.active, retired])

    def alive(self, entry: tuple, at: int) -> bool:
        return (entry[6] is None or at < entry[6]) and (-entry[2], -entry[1]) not in self.retired

    def best(self, at: int) -> tuple | None:
        if len(self.heap) > self.room:
            self.heap = [e for e in self.heap if self.alive(e, at)]
            heapq.heapify(self.heap)
            self.retired = {key: stale for key, stale in self.retired.items() if stale is None or at < stale}
            self.room = max(1024, 2 * len(self.heap))
        while self.heap and not self.alive(self.heap[0], at):
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None

    def step(self, row: tuple) -> list[tuple]:
        at, bar, low, high, close, p1, v1, p2, v2, score, stale = row
        if not bar:
            heapq.heappush(self.heap, (-score, -p2, -p1, v1, v2, at, stale))
            return []
        rules, best, active = self.rules, self.best(at), self.active
        key = None if best is None else (-best[2], -best[1])
        if best is not None and (active is None or (key != active["key"] and -best[0] > active["score"] * rules.replacement)):
            active = {"key": key, "line": (key[0], best[3], key[1], best[4]), "stale": best[6], "base": -best[0], "score": -best[0], "touches": 0, "rejections": 0, "breaks": 0, "born": at, "touched": at}
        self.active = active
        if active is None:
            return []
        p1, v1, p2, v2 = active["line"]
        value = v2 + (v2 - v1) / (p2 - p1) * (at - p2)
        tolerance = close * rules.tolerance
        touched = abs((low if self.up > 0 else high) - value) <= tolerance
        if touched:
            active["touches"] += 1
            active["touched"] = at
            active["rejections"] += (close - value) * self.up > 0
        broken = close < value - tolerance if self.up > 0 else close > value + tolerance
        active["breaks"] = active["breaks"] + 1 if broken else 0
        untouched = at - active["touched"]
        active["score"] = (
            active["base"]
            + (active["touches"] * 18.0 + active["rejections"] * 24.0)
            + min(at - active["born"], 160) * 0.35
            + max(rules.recent - untouched, 0) * 2.0
            - max(untouched - rules.recent, 0) * 4.0
            - active["breaks"] * 55.0
        )
        if active["breaks"] >= rules.max_breaks or untouched > rules.max_untouched or active["score"] < rules.min_active:
            self.retired[active["key"]] = active["stale"]
            self.active = None
        return [(*self.key, at, value, p1, v1, p2, v2)]


def active_lines(bars: DataFrame, line: DataFrame, rules: Rules = DEFAULT, size: int = BLOCK, halo: int = HALO) -> DataFrame:
    """One row for each bar and side that has an active line. Bars without a price are
    passed over. A pair goes to the blocks of bars at which it can be used. Any block size
    and halo give the same rows."""
    none = lambda kind: F.lit(None).cast(kind)
    pair = ["first_pos", "first_price", "second_pos", "second_price", "score", "stale"]
    kinds = ["long", "double", "long", "double", "double", "long"]
    priced = bars.where(F.col("Close").isNotNull() & F.col("Low").isNotNull() & F.col("High").isNotNull())
    at = F.col("position")
    both = priced.select("symbol", F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side"), at.alias("at"), at.alias("until"), F.lit(1).alias("event"), "Low", "High", "Close", *[none(k).alias(c) for c, k in zip(pair, kinds, strict=True)])
    until = F.coalesce(F.col("stale"), F.col("second_pos") + F.col("persistence") + 1) - 1
    usable = line.select("symbol", "side", F.col("usable_from").alias("at"), until.alias("until"), F.lit(0).alias("event"), *[none("double").alias(c) for c in ("Low", "High", "Close")], *[F.col(c).cast(k) for c, k in zip(pair, kinds, strict=True)])
    return in_blocks(both.union(usable), KEYS, lambda symbol, side: Follower(symbol, side, rules), LINE_COLUMNS, size, halo)


def with_lines(marked: DataFrame, anchor: DataFrame, active: DataFrame) -> DataFrame:
    """marked (bars with swings) and the scores of anchors and both lines with their
    anchors."""
    scores = anchor.groupBy("symbol", "position").agg(
        F.max(F.when(F.col("side") == "resistance", F.col("score"))).alias("swing_high_score"),
        F.max(F.when(F.col("side") == "support", F.col("score"))).alias("swing_low_score"),
    )
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    wide = active.groupBy("symbol", "position").agg(
        *[of(s, "line").alias(f"anchored_{s}") for s in SIDES],
        *[of(s, f"{n}_{c}").alias(f"{s}_anchor_{i}_{name}") for s in SIDES for i, n in ((1, "first"), (2, "second")) for c, name in (("pos", "position"), ("price", "price"))],
    )
    df = marked.drop("high_strength", "low_strength", "local_volatility").join(scores, ["symbol", "position"], "left").join(wide, ["symbol", "position"], "left")
    return df.withColumns({"swing_high_score": F.coalesce("swing_high_score", F.lit(0.0)), "swing_low_score": F.coalesce("swing_low_score", F.lit(0.0))})


def breakouts(df: DataFrame, keys=("symbol",), rules: Rules = DEFAULT) -> DataFrame:
    """df (bars with lines) and distances, breakouts, breakdowns, failed breakdowns."""
    c, support, resistance = F.col("Close"), F.col("anchored_support"), F.col("anchored_resistance")
    n = rules.confirmation
    frame = Frames(keys).rows(-(n - 1), 0)
    return df.withColumns(
        {
            "distance_to_anchored_support": div(c - support, c),
            "distance_to_anchored_resistance": div(resistance - c, c),
            "anchored_breakout": flag(F.sum(flag(c > resistance)).over(frame) == n),
            "anchored_breakdown": flag(F.sum(flag(c < support)).over(frame) == n),
            "failed_breakdown": flag((F.col("Low") < support) & (c > support)),
        }
    )
