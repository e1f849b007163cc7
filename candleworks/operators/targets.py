"""Labels: the dominant move over the next bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div
from ..functions.frames import Frames

HORIZON, THRESHOLD = 12, 0.0045


def targets(bars: DataFrame, keys=("symbol",), horizon: int = HORIZON, threshold: float = THRESHOLD) -> DataFrame:
    """bars with the next bars' highest High and lowest Low, their returns, target_d
    (2 up, 0 down, 1 neither or not enough bars) and target_p (the dominant return)."""
    f = Frames(keys)
    c = F.col("Close")
    df = bars.withColumns({"future_max_high": f.ahead(F.max, F.col("High"), horizon), "future_min_low": f.ahead(F.min, F.col("Low"), horizon)})
    df = df.withColumns({"future_max_return": div(F.col("future_max_high") - c, c), "future_min_return": div(F.col("future_min_low") - c, c)})
    up, down = F.col("future_max_return"), F.col("future_min_return")
    bull = (up > F.abs(down)) & (up > threshold)
    bear = (F.abs(down) > up) & (F.abs(down) > threshold)
    return df.withColumns({"target_d": F.when(bull, 2).when(bear, 0).otherwise(1), "target_p": F.when(bull, up).when(bear, down).otherwise(0.0)})
