"""Small column expressions: flags, safe division, rounding, names, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is unknown; never null."""
    return F.when(condition, 1).otherwise(0)


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def round_price(x: Column, places: int = 2) -> Column:
    """Scaled, rounded half to even, scaled back."""
    scale = 10.0**places
    return F.rint(x * scale) / scale


def finite(x: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def whole(x: Column) -> Column:
    """The finite number without its fraction, or null."""
    return finite(x).cast("long")


def base_symbol(symbol: Column) -> Column:
    """Upper case, up to the first dot."""
    return F.split_part(F.upper(symbol), F.lit("."), F.lit(1))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def parse_time(text: Column) -> Column:
    """Timestamps in mixed ISO forms, with or without an offset; junk raises."""
    return text.cast("timestamp")


def exchange_time(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """The instant as the exchange's wall clock shows it."""
    return F.from_utc_timestamp(ts, zone)
