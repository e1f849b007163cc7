"""Window frames over bars in time order, within a symbol or a part of one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import kept
from .columns import flag


class Frames:
    """Frames over (keys, Datetime). keys is ("symbol",), or with a chunk number for
    long histories (see `chunks`)."""

    def __init__(self, keys: Sequence[str] = ("symbol",)):
        self.keys = tuple(keys)
        self.w = Window.partitionBy(*self.keys).orderBy("Datetime")

    def rows(self, first: int, last: int):
        return self.w.rowsBetween(first, last)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(x, n).over(self.w)

    def roll(self, agg: Callable, x: Column, n: int) -> Column:
        """agg of the last n values of x, null until n values are there."""
        frame = self.rows(-(n - 1), 0)
        return F.when(F.count(x).over(frame) == n, agg(x).over(frame))

    def ahead(self, agg: Callable, x: Column, n: int) -> Column:
        """agg of the next n values of x, null unless all are there."""
        frame = self.rows(1, n)
        return F.when(F.count(x).over(frame) == n, agg(x).over(frame))

    def slope(self, y: Column, x: Column, n: int) -> Column:
        """Least-squares slope of the last n values."""
        frame = self.rows(-(n - 1), 0)
        return F.when(F.count(y).over(frame) == n, F.regr_slope(y, x).over(frame))

    def median(self, x: Column, n: int) -> Column:
        frame = self.rows(-(n - 1), 0)
        return F.when(F.count(x).over(frame) == n, F.percentile(x, F.lit(0.5)).over(frame))

    def crosses(self, a: str, b: str, up: bool) -> Column:
        """a crosses b on this bar, upwards or downwards."""
        p, q = self.lag(a), self.lag(b)
        if up:
            return flag((p <= q) & (F.col(a) > F.col(b)))
        return flag((p >= q) & (F.col(a) < F.col(b)))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with `__rank`, 0-based in the order given, nulls first. Rows are dealt by range
    and numbered in their partition; the partitions' counts, a row for each, give what is
    before it. No task needs a whole symbol or day; ties are in no certain order. The
    numbered rows are written, so that a number stays with its row. Rows are read twice, for
    the bounds of the ranges and then for themselves: write what is dear to make."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    numbered = kept(dealt).withColumn("__range", F.shiftright("__at", 33))
    counts = numbered.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("__range", (before - F.col("__first")).alias("__base"))
    return numbered.join(F.broadcast(bases), "__range").withColumn("__rank", F.col("__at") + F.col("__base")).select(*rows.columns, "__rank")


def ordinals(bars: DataFrame, whole: bool = False) -> DataFrame:
    """bars with `position` (0-based in its symbol) and, with `whole`, `global_position`
    (0-based in (symbol, time) order). Bars are numbered over all symbols by range; what is
    before a symbol is the least of its numbers. A null symbol is one of its own and comes
    first, as does a null time in its symbol. No bar is lost."""
    rows = ranked(bars, ("symbol", "Datetime"))
    firsts = rows.groupBy(F.col("symbol").alias("__symbol")).agg(F.min("__rank").alias("__first"))
    met = rows.join(firsts, F.col("symbol").eqNullSafe(F.col("__symbol")))
    position = (F.col("__rank") - F.col("__first")).cast("long").alias("position")
    return met.select(*bars.columns, position, *([F.col("__rank").cast("long").alias("global_position")] if whole else []))


#: Bars that a feature looks back (previous close, 14 true ranges, 100 ratios) and ahead.
LOOK_BACK, LOOK_AHEAD = 128, 24


def chunks(bars: DataFrame, size: int = 4096) -> DataFrame:
    """bars with positions, cut into chunks of `size` bars a symbol; the last bars of
    a chunk are also in the next, the first also in the previous, marked as not own.
    Frames over (symbol, chunk) give own bars the values that frames over the symbol
    would, in tasks of bounded size. A chunk smaller than the look-back raises ValueError."""
    if size < LOOK_BACK:
        raise ValueError(f"chunks need {LOOK_BACK} bars")
    own = F.floor(F.col("position") / size).cast("long")
    inside = F.col("position") % size
    copies = F.array_compact(
        F.array(own, F.when(inside >= size - LOOK_BACK, own + 1), F.when((inside < LOOK_AHEAD) & (own > 0), own - 1))
    )
    numbered = bars if "position" in bars.columns else ordinals(bars)
    return numbered.withColumn("chunk", F.explode(copies)).withColumn("own", F.col("chunk") == own)
