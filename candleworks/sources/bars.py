"""Bars: from files, from ticks; cleaning, tagging, stacking, checks; sinks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_time, round_price

PRICES = ["Open", "High", "Low", "Close"]
BAR_COLUMNS = ["Datetime", *PRICES, "Volume", "symbol"]
BARS = T.StructType(
    [T.StructField("Datetime", T.TimestampType())]
    + [T.StructField(p, T.DoubleType()) for p in PRICES]
    + [T.StructField("Volume", T.LongType()), T.StructField("symbol", T.StringType())]
)


def missing(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that df lacks, in their order."""
    return [c for c in columns if c not in df.columns]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, if it has all the columns; else ValueError names those it lacks."""
    lacking = missing(df, columns)
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def not_empty(df: DataFrame, what: str = "rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def guarded(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, n, empty) of the requested symbols: those without bars are empty."""
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    found = requested.distinct().join(counts, "symbol", "left")
    return found.select("symbol", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("empty"))


def unique_times(bars: DataFrame) -> DataFrame:
    """bars, if no (symbol, Datetime) repeats: window order would not be certain."""
    if not bars.groupBy("symbol", "Datetime").count().where("count > 1").isEmpty():
        raise ValueError("some (symbol, Datetime) repeat")
    return bars


#: Cells that count as missing.
MISSING = ["", "#N/A", "N/A", "NA", "NaN", "nan", "None", "NULL", "null", "n/a", "<NA>"]
RECORD = "__record"


def checked_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, matched by name: the bar columns, `refused` (what is
    wrong, null if nothing is) and `record` (the line as it stands, where its cells do not
    fit the header).

    Columns may come in any order and others may be there; ValueError names those that are
    missing. All files must have the same header, else reading fails. Refused are a
    line with more or fewer cells than the header ("record"), and cells that are neither
    missing nor a number, a whole number (Volume) or a time in a mixed ISO form (the
    column's name); a refused cell is null. Missing cells are null.
    """
    names = require(spark.read.csv(path, header=True), BAR_COLUMNS).columns
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    options = {"header": True, "enforceSchema": False, "columnNameOfCorruptRecord": RECORD, "columnPruning": False}  # pruned lines would not be checked
    lines = spark.read.schema(texts).options(**options).csv(path)

    def cell(name: str):
        text = F.trim(F.col(f"`{name}`"))
        return F.when(~text.isin(MISSING), text)

    def value(name: str):
        kind = BARS[name].dataType
        number = cell(name).try_cast("double")
        if name == "Volume":  # 12 and 12.0 alike
            return F.coalesce(cell(name).try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))
        return number if kind == T.DoubleType() else cell(name) if kind == T.StringType() else cell(name).try_cast("timestamp")

    bad = F.array_compact(F.array(F.when(F.col(RECORD).isNotNull(), "record"), *[F.when(cell(c).isNotNull() & value(c).isNull(), c) for c in BAR_COLUMNS]))
    return lines.select(*[value(c).alias(c) for c in BAR_COLUMNS], F.when(F.size(bad) > 0, F.array_join(bad, ",")).alias("refused"), F.col(RECORD).alias("record"))


def read_csv(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Bars from CSV by the names of the header (see `checked_csv`). A refused row raises
    an error; with quarantine, refused rows are written to that path as JSON lines, with
    what is wrong, and the others are returned."""
    rows = checked_csv(spark, path)
    if quarantine is None:
        said = F.concat(F.lit("refused: "), F.col("refused"), F.lit(" in "), F.to_json(F.struct(*BAR_COLUMNS)))
        sound = rows.where(F.when(F.col("refused").isNull(), True).otherwise(F.raise_error(said).cast("boolean")))
    else:
        rows.where(F.col("refused").isNotNull()).write.json(quarantine)
        sound = rows.where(F.col("refused").isNull())
    return sound.select(*BAR_COLUMNS)


def read_table(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Bars or features that `write` wrote in a folder for each symbol. Symbols come back as
    the text they are, 007 too (a partition's type would otherwise be guessed from its
    names); a filter on symbol reads that symbol's folders only. An empty symbol is written
    like a null one and comes back as null."""
    found = spark.read.format(form).load(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name == "symbol" else f for f in found])).format(form).load(path)


def one_symbol(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """The bars of one symbol in time order, from its folder alone."""
    return read_table(spark, path).where(F.col("symbol") == symbol).orderBy("Datetime")


def flatten_names(df: DataFrame) -> DataFrame:
    """Two-level column names like "Close/ABC" become their first level."""
    return df.toDF(*[c.split("/")[0] for c in df.columns])


def round_prices(bars: DataFrame) -> DataFrame:
    return bars.withColumns({p: round_price(F.col(p)) for p in PRICES})


def tag(bars: DataFrame, symbol: str | Column) -> DataFrame:
    """bars with a name, or an expression of one, as their symbol."""
    return bars.withColumn("symbol", symbol if isinstance(symbol, Column) else F.lit(symbol))


def stack(frames: list[DataFrame]) -> DataFrame:
    """One table of several symbols' bars."""
    if not frames:
        raise ValueError("no bars")
    return reduce(lambda a, b: a.unionByName(b), frames)


def select_bars(df: DataFrame) -> DataFrame:
    return require(df, BAR_COLUMNS).select(*BAR_COLUMNS)


def in_order(bars: DataFrame) -> DataFrame:
    return bars.orderBy("symbol", "Datetime")


def from_ticks(ticks: DataFrame, width: str = "15 minutes", period: str | None = None, end=None) -> DataFrame:
    """Bars of a width from ticks (symbol, ts, id, price, volume): first, largest,
    smallest and last price, summed volume. With `period`, only bars that begin within
    it before `end` (or the last tick). Ticks of one time are ordered by id."""
    at = F.struct("ts", "id")
    bars = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("Open"),
        F.max("price").alias("High"),
        F.min("price").alias("Low"),
        F.max_by("price", at).alias("Close"),
        F.sum("volume").cast("long").alias("Volume"),
    )
    bars = bars.select(F.col("w.start").alias("Datetime"), *PRICES, "Volume", "symbol")
    if period is None:
        return bars
    last = F.lit(end) if end is not None else F.lit(ticks.agg(F.max("ts")).first()[0])
    return bars.where(F.col("Datetime") >= last - F.expr(f"INTERVAL {period}"))


def without_bars(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested symbols that got no bars."""
    return requested.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"))


def symbols(bars: DataFrame) -> DataFrame:
    """Distinct symbols that are not missing, in order."""
    return bars.where(F.col("symbol").isNotNull()).select("symbol").distinct().orderBy("symbol")


def new_path(spark: SparkSession) -> str:
    """A new folder where driver and executors both see it: under spark.checkpoint.dir,
    or, in local mode alone, a temporary one where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-candleworks-")
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to a new folder and read back: what uses it more than once starts
    from the files, and so does a job after executors are lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write bars or features, a folder for each symbol, each file in time order; CSV
    with a header instead, or JSON lines."""
    ordered = df.repartitionByRange("symbol", "Datetime").sortWithinPartitions("symbol", "Datetime")
    if form == "csv":
        ordered.write.csv(path, header=True)
    else:
        ordered.write.format(form).partitionBy("symbol").save(path)


def walk_ticks(events: DataFrame) -> DataFrame:
    """Ticks with a random-walk price from the `events` table: running sums of value in
    whole cents. Sums run within a day; day totals, summed up in a small table, carry
    over, so no task needs all events of a type."""
    cents = (F.round(F.col("value") * 100).cast("long") - 5000).alias("cents")
    steps = events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), cents, F.to_date("ts").alias("day"))
    earlier = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = steps.groupBy("symbol", "day").agg(F.sum("cents").alias("total"))
    days = days.select("symbol", "day", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    so_far = Window.partitionBy("symbol", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.withColumn("so_far", F.sum("cents").over(so_far)).join(days, ["symbol", "day"])
    price = F.expr("(2000000 + before + so_far) DIV 20") / F.lit(100.0)
    return summed.select("symbol", "ts", "id", price.alias("price"), (F.lit(1) + F.col("id") % 97).alias("volume"))
