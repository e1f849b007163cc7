"""Feature table to chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chart
from ..sources.bars import not_empty, write


def chart_tables(features: DataFrame, wanted: str, n: int = chart.CANDLES) -> dict[str, DataFrame]:
    visible = chart.last_candles(chart.records(features), n)
    return {"rows": visible, "candles": chart.candles(visible), "rays": chart.rays(visible), "markers": chart.markers(visible), "symbols": chart.symbols(features), "default": chart.default_symbol(features, wanted)}


def write_chart(features: DataFrame, path: str) -> None:
    """All chart rows as JSON lines, a folder for each symbol, files in time order."""
    rows = not_empty(features, "symbols").select(*chart.REQUIRED)
    write(chart.records(rows).withColumn("Datetime", F.timestamp_seconds("time")), path, "json")
