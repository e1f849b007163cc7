"""Bars to the feature and target table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.frames import ordinals
from ..operators import structure
from ..operators.features import candle_features, in_chunks
from ..operators.targets import targets
from ..sources.bars import BAR_COLUMNS, kept, not_empty, require, select_bars, unique_times

#: The 44 model features, in order.
FEATURE_COLUMNS = [
    "body_mid", "momentum", "return_1",
    "avg_volume", "volume_spike", "directional_volume",
    "volatility", "atr_14", "atr_ratio", "adx_14",
    "high_volatility_market", "low_volatility_market", "trending_market", "volatility_expansion",
    "rolling_avg_momentum", "directional_persistence",
    "compression_width", "swing_high", "swing_low",
    "anchored_support", "anchored_resistance", "distance_to_anchored_support", "distance_to_anchored_resistance",
    "pivot_mean", "pivot_distance",
    "lower_wick", "upper_wick", "wick_ratio",
    "bearish_sequence_strength", "bullish_sequence_strength",
    "anchored_breakout", "anchored_breakdown",
    "trend_slope_50", "trend_slope_100",
    "ma_20", "ma_50", "ma_100",
    "bullish_cross_20_50", "bearish_cross_20_50", "ma_cross_distance_20_50", "ma_cross_distance_50_100",
    "rolling_higher_highs", "rolling_lower_lows",
    "equilibrium_trend_distance",
]
TARGETS = ["target_d", "target_p"]
INTERMEDIATE = ["tr", "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "future_max_high", "future_min_low", "future_max_return", "future_min_return"]


#: Bars of a chunk; windows run over chunks with a halo, so one symbol is many tasks.
CHUNK = 4096


def positioned(bars: DataFrame) -> DataFrame:
    """bars with their positions. No bars, missing columns and repeated (symbol,
    Datetime), whose order would not be certain, raise ValueError."""
    return ordinals(unique_times(not_empty(select_bars(bars), "bars")), whole=True)


def structured(bars: DataFrame, rules: structure.Rules = structure.DEFAULT) -> DataFrame:
    """Positioned bars with all structure columns."""
    marked = kept(in_chunks(bars, lambda b, keys: structure.swings(b, keys, rules), CHUNK))
    anchor = structure.anchors(structure.pivots(marked, rules), rules)
    line = structure.lines(structure.pairs(anchor, bars, rules), bars, rules)
    lined = structure.with_lines(marked, anchor, structure.active_lines(bars, line, rules))
    return in_chunks(lined, lambda b, keys: structure.breakouts(b, keys, rules), CHUNK)


def all_columns(bars: DataFrame, rules: structure.Rules = structure.DEFAULT) -> DataFrame:
    """Every feature and target of every bar, before rows with missing values go."""
    numbered = kept(positioned(kept(require(bars, BAR_COLUMNS))))
    candles = in_chunks(numbered, lambda b, keys: targets(candle_features(b, keys), keys), CHUNK).drop(*INTERMEDIATE)
    lines = structured(numbered, rules).drop(*[c for c in numbered.columns if c not in ("symbol", "position")])
    return candles.join(lines, ["symbol", "position"])


def feature_table(bars: DataFrame, rules: structure.Rules = structure.DEFAULT) -> DataFrame:
    """The feature table: bars past every warm-up that have both lines active."""
    return all_columns(bars, rules).na.drop("any")


def model_table(features: DataFrame) -> DataFrame:
    """Keys, the 44 features and both targets of rows that have targets."""
    return features.na.drop(subset=TARGETS).select("symbol", "Datetime", "position", *FEATURE_COLUMNS, *TARGETS)
