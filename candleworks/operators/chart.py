"""Chart tables: bar records, last candles, rays, markers, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import base_symbol, epoch_seconds, finite, whole
from ..sources.bars import not_empty, require, symbols

SIDES = ("support", "resistance")

#: Names of the fields that the page reads, and its choices of candles.
REQUIRED = ["symbol", "Datetime", "position", "Open", "High", "Low", "Close", "Volume", "swing_high", "swing_low", "anchored_breakout", "anchored_breakdown"] + [f"{s}_anchor_{i}_{c}" for s in SIDES for i in (1, 2) for c in ("position", "price")]
CANDLES, CANDLE_OPTIONS = 500, [100, 200, 300, 500, 1000]


def records(features: DataFrame) -> DataFrame:
    """One record for each bar: numbers finite or null, flags as booleans."""
    flags = {"swingHigh": "swing_high", "swingLow": "swing_low", "anchoredBreakout": "anchored_breakout", "anchoredBreakdown": "anchored_breakdown"}
    return require(features, REQUIRED).select(
        "symbol",
        epoch_seconds(F.col("Datetime")).alias("time"),
        *[finite(F.col(c).cast("double")).alias(c.lower()) for c in ("Open", "High", "Low", "Close", "Volume")],
        "position",
        *[(F.col(c) == 1).alias(name) for name, c in flags.items()],
        *[f(F.col(f"{s}_anchor_{i}_{c}").cast("double")).alias(f"{s}Anchor{i}{c.title()}") for s in SIDES for i in (1, 2) for c, f in (("position", whole), ("price", finite))],
    )


def last_candles(records: DataFrame, n: int = CANDLES) -> DataFrame:
    """The last n records of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("position"))
    return records.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def candles(records: DataFrame) -> DataFrame:
    return records.select("symbol", "time", "open", "high", "low", "close")


def default_symbol(features: DataFrame, wanted: str) -> DataFrame:
    """One row: the first symbol that matches by full or base name, else the first."""
    full = F.upper("symbol")
    match = (full == wanted.upper()) | (base_symbol(F.col("symbol")) == wanted.upper())
    return symbols(features).withColumn("__m", match).orderBy(F.desc("__m"), "symbol").limit(1).select("symbol")


def latest_anchors(visible: DataFrame) -> DataFrame:
    """(symbol, side, anchor1Position, anchor1Price, anchor2Position, anchor2Price) of
    the latest visible bar that has all four."""
    parts = None
    for side in SIDES:
        names = [f"{side}Anchor{i}{c}" for i in (1, 2) for c in ("Position", "Price")]
        anchor = F.struct(*[F.col(n).alias(n.removeprefix(side).replace("Anchor", "anchor")) for n in names])
        one = visible.where(" and ".join(f"{n} is not null" for n in names)).groupBy("symbol").agg(F.max_by(anchor, F.col("position")).alias("a")).select("symbol", F.lit(side).alias("side"), "a.*")
        parts = one if parts is None else parts.unionByName(one)
    return parts


def rays(visible: DataFrame) -> DataFrame:
    """The latest anchors' line over the visible bars; none if both share a position.
    Anchors are at most two rows a symbol."""
    anchors = latest_anchors(visible).where("anchor1Position <> anchor2Position")
    slope = (F.col("anchor2Price") - F.col("anchor1Price")) / (F.col("anchor2Position") - F.col("anchor1Position"))
    met = visible.select("symbol", "time", "position").join(anchors, "symbol")
    return met.select("symbol", "side", "position", "time", (F.col("anchor1Price") + slope * (F.col("position") - F.col("anchor1Position"))).alias("value"))


def markers(visible: DataFrame) -> DataFrame:
    """Long table of pivots and signals: (symbol, time, kind, place)."""
    kinds = [("swingHigh", "SH", "aboveBar"), ("swingLow", "SL", "belowBar"), ("anchoredBreakout", "BO", "aboveBar"), ("anchoredBreakdown", "BD", "belowBar")]
    options = F.array_compact(F.array(*[F.when(F.col(c), F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"))) for c, kind, place in kinds]))
    return visible.select("symbol", "time", F.explode(options).alias("m")).select("symbol", "time", "m.kind", "m.place")


def payload(records: DataFrame, page: int = CANDLES) -> DataFrame:
    """(symbol, page, rows): all records of each symbol, in order, in pages of as many
    positions; a page bounds a row, and nothing is left out. Pages without records are
    not there."""
    names = [c for c in records.columns if c != "symbol"]
    record = F.struct("position", *[c for c in names if c != "position"])
    paged = records.groupBy("symbol", F.floor(F.col("position") / page).cast("long").alias("page"))
    return paged.agg(F.array_sort(F.collect_list(record)).alias("rows"))


def payload_json(features: DataFrame, wanted: str, n: int = CANDLES, clean=None) -> DataFrame:
    """(field, symbol, page, json): what the page reads. `symbols`, `defaultSymbol`,
    `defaultCandleCount` and `candleCountOptions` are a row each, without a symbol; each
    symbol has a row `series` for each page of n positions, with its records in order:
    one after the other they are all the symbol's records. Null values stay as null.
    `clean` changes the records first. No symbol raises ValueError."""
    records_of = records(features)
    records_of = records_of if clean is None else clean(records_of)
    json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda field, text, symbol=none, page=nowhere: (F.lit(field).alias("field"), symbol.alias("symbol"), page.alias("page"), text.alias("json"))
    series = payload(records_of.where(F.col("symbol").isNotNull()), n).select(*row("series", json("rows"), F.col("symbol"), F.col("page")))
    names = not_empty(symbols(features), "symbols").agg(F.array_sort(F.collect_list("symbol")).alias("s")).select(*row("symbols", json("s")))
    default = default_symbol(features, wanted).select(*row("defaultSymbol", F.concat(F.lit('"'), F.col("symbol"), F.lit('"'))))
    fixed = features.sparkSession.range(1)
    count = fixed.select(*row("defaultCandleCount", F.lit(str(n))))
    options = fixed.select(*row("candleCountOptions", json(F.array(*map(F.lit, CANDLE_OPTIONS)))))
    return names.union(default).union(count).union(options).union(series)
