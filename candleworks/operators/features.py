"""Candle features: one row in, one row out, all frames over the same partitioning.

Missing values are null. A trailing feature is null until its frame is full; flags
are 0 where their condition is unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div, flag
from ..functions.frames import Frames, chunks

TINY = 1e-9



def candle_features(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """bars (with `position`) and all candle, volatility, regime and trend columns.
    Intermediate columns (tr, plus_dm, minus_dm, plus_di, minus_di, dx) stay."""
    f = Frames(keys)
    col = F.col
    o, h, l, c, v = map(col, ("Open", "High", "Low", "Close", "Volume"))
    previous = f.lag("Close")
    up, down = h - f.lag("High"), f.lag("Low") - l
    df = bars.withColumns(
        {
            "body_mid": (o + c) / 2,
            "directional_volume": (c - o) * v,
            "lower_wick": F.least(o, c) - l,
            "upper_wick": h - F.greatest(o, c),
            "momentum": c - f.lag("Close", 8),
            "return_1": div(c, previous) - 1,
            "avg_volume": f.roll(F.avg, v, 20),
            "tr": F.greatest(h - l, F.abs(h - previous), F.abs(l - previous)),
            "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "compression_width": f.roll(F.max, h, 20) - f.roll(F.min, l, 20),
            "bearish_sequence_strength": f.roll(F.sum, flag(c < o), 5),
            "bullish_sequence_strength": f.roll(F.sum, flag(c > o), 5),
            "pivot_mean": f.roll(F.avg, c, 20),
            "trend_slope_50": f.slope(c, col("position"), 50),
            "trend_slope_100": f.slope(c, col("position"), 100),
            "ma_20": f.roll(F.avg, c, 20),
            "ma_50": f.roll(F.avg, c, 50),
            "ma_100": f.roll(F.avg, c, 100),
            "__higher": flag(h > f.lag("High")),
            "__lower": flag(l < f.lag("Low")),
        }
    )
    df = df.withColumns(
        {
            "wick_ratio": col("lower_wick") / (col("upper_wick") + TINY),
            "volume_spike": div(v, col("avg_volume")),
            "volatility": f.roll(F.stddev_samp, col("return_1"), 10),
            "atr_14": f.roll(F.avg, col("tr"), 14),
            "plus_di": 100 * f.roll(F.sum, col("plus_dm"), 14) / (f.roll(F.sum, col("tr"), 14) + TINY),
            "minus_di": 100 * f.roll(F.sum, col("minus_dm"), 14) / (f.roll(F.sum, col("tr"), 14) + TINY),
            "rolling_avg_momentum": f.roll(F.avg, col("momentum"), 10),
            "pivot_distance": div(c - col("pivot_mean"), c),
            "rolling_higher_highs": f.roll(F.sum, col("__higher"), 20),
            "rolling_lower_lows": f.roll(F.sum, col("__lower"), 20),
            "directional_persistence": f.roll(F.avg, F.signum("return_1"), 20),
            "bullish_cross_20_50": f.crosses("ma_20", "ma_50", True),
            "bearish_cross_20_50": f.crosses("ma_20", "ma_50", False),
            "bullish_cross_50_100": f.crosses("ma_50", "ma_100", True),
            "bearish_cross_50_100": f.crosses("ma_50", "ma_100", False),
            "ma_cross_distance_20_50": div(col("ma_20") - col("ma_50"), c),
            "ma_cross_distance_50_100": div(col("ma_50") - col("ma_100"), c),
        }
    ).drop("__higher", "__lower")
    df = df.withColumns(
        {
            "dx": 100 * F.abs(col("plus_di") - col("minus_di")) / (col("plus_di") + col("minus_di") + TINY),
            "atr_ratio": div(col("atr_14"), c),
            "volatility_expansion": div(col("volatility"), f.roll(F.avg, col("volatility"), 20)),
            "equilibrium_trend_distance": col("pivot_distance") * col("directional_persistence"),
        }
    )
    df = df.withColumns({"adx_14": f.roll(F.avg, col("dx"), 14), "__median": f.median(col("atr_ratio"), 100)})
    return df.withColumns(
        {
            "trending_market": flag(col("adx_14") > 25),
            "ranging_market": flag(col("adx_14") < 20),
            "high_volatility_market": flag(col("atr_ratio") > col("__median")),
            "low_volatility_market": flag(col("atr_ratio") < col("__median")),
        }
    ).drop("__median")


def in_chunks(bars: DataFrame, apply, size: int = 4096) -> DataFrame:
    """apply(bars, keys) over chunks with a halo; own rows only. Equal to apply over
    whole symbols, for few symbols with long histories."""
    return apply(chunks(bars, size), ("symbol", "chunk")).where("own").drop("chunk", "own")
