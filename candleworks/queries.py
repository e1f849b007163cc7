"""Registered queries of the candle jobs, each over bars built from `events`.

Doubles are rounded to six places, so that two engines that add in different orders
give equal values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import base_symbol, epoch_seconds, exchange_time, parse_time, round_price
from .functions.frames import Frames, ordinals
from .operators import boosting, chart, metrics, model, structure
from .operators.features import candle_features, in_chunks
from .operators.targets import targets
from .plans import features as job
from .plans.chart import write_chart
from .sources import bars as source


#: Counts that are missing until their frame is full: given as doubles.
COUNTS = ("bearish_sequence_strength", "bullish_sequence_strength", "rolling_higher_highs", "rolling_lower_lows")


#: wick_ratio reaches 1e10, where doubles have fewer sure places.
PLACES = {"wick_ratio": 3}


def rounded(df: DataFrame) -> DataFrame:
    """df with doubles rounded and timestamps without a zone."""
    df = df.withColumns({c: F.col(c).cast("double") for c in COUNTS if c in df.columns})
    change = {"double": lambda c: F.round(F.col(c), PLACES.get(c, 6)), "timestamp": lambda c: F.col(c).cast("timestamp_ntz")}
    return df.select(*[change[t](c).alias(c) if t in change else F.col(c) for c, t in df.dtypes])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return source.walk_ticks(events.withColumn("ts", F.col("ts").cast("timestamp")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.select_bars(source.from_ticks(ticks(spark, sf_dir), "1 hour"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals(source.kept(hourly(spark, sf_dir)))


def candle_query(*columns: str):
    """Some columns of the candle features and targets of every bar."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply = lambda b, keys: targets(candle_features(b, keys), keys)
        return rounded(in_chunks(numbered(spark, sf_dir), apply).select("symbol", "position", *columns))

    return run


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered bars for the jobs that use them several times."""
    return source.kept(numbered(spark, sf_dir))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_chunks(stored(spark, sf_dir), structure.swings)


def anchored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = stored(spark, sf_dir)
    return bars, structure.anchors(structure.pivots(source.kept(in_chunks(bars, structure.swings))))


def paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars, anchor = anchored(spark, sf_dir)
    return bars, structure.pairs(anchor, bars)


def with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.structured(stored(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job.feature_table(hourly(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up prediction table over the bars with returns: class by position,
    value by the last return."""
    rows = targets(candle_features(numbered(spark, sf_dir))).where("return_1 is not null")
    rows = model.split(source.kept(rows.select("symbol", "Datetime", "position", "target_d", "target_p", "return_1")))
    return source.kept(rows).select("symbol", "Datetime", "position", "part", F.col("target_d").alias("actual_d"), (F.col("position") % 3).cast("int").alias("predicted_d"), F.col("target_p").alias("actual_p"), F.col("return_1").alias("predicted_p"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.records(with_lines(spark, sf_dir))


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.last_candles(records(spark, sf_dir), 200)


# ---------------------------------------------------------------- sources and sets


def s01_read_bars(spark, sf_dir):
    """Bars written as CSV and read back with the bar schema."""
    path = source.new_path(spark)
    source.write(hourly(spark, sf_dir).select(*source.BAR_COLUMNS), path, "csv")
    return rounded(source.read_csv(spark, path))


def damaged_csv(spark, sf_dir):
    """Bars as CSV: columns in another order, one more, and cells that are no number or time
    or that are missing."""
    bars = numbered(spark, sf_dir)
    at = F.col("position") % 50
    text = lambda c: F.col(c).cast("string")
    cells = {
        "symbol": F.col("symbol"), "Note": F.concat(F.lit("bar, "), text("position")), "Volume": F.when(at == 21, "1.5").otherwise(text("Volume")),
        "Close": F.when(at == 7, "x").otherwise(text("Close")), "Low": text("Low"), "Open": F.when(at == 29, "NA").otherwise(text("Open")), "High": text("High"),
        "Datetime": F.when(at == 13, "yesterday").otherwise(F.date_format("Datetime", "yyyy-MM-dd HH:mm:ss")),
    }
    path = source.new_path(spark)
    bars.select(*[c.alias(n) for n, c in cells.items()]).write.csv(path, header=True)
    return path


def s01_named_csv(spark, sf_dir):
    """Bars from CSV by the names of its header; refused rows are put aside."""
    return rounded(source.read_csv(spark, damaged_csv(spark, sf_dir), source.new_path(spark)))


def s01_refused_rows(spark, sf_dir):
    """The rows of the same CSV that were put aside, read back from where they were written."""
    aside = source.new_path(spark)
    source.read_csv(spark, damaged_csv(spark, sf_dir), aside)
    rows = spark.read.schema(f"{source.BARS.simpleString()[7:-1].replace(':', ' ')}, refused string").json(aside)
    return rounded(rows.select("symbol", "Datetime", "High", "Close", "Volume", "refused"))


def s02_bars_from_ticks(spark, sf_dir):
    return rounded(hourly(spark, sf_dir))


def s02_recent_bars(spark, sf_dir):
    return rounded(source.from_ticks(ticks(spark, sf_dir), "15 minutes", "7 days"))


def s03_parse_times(spark, sf_dir):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+05:30").otherwise(""))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.alias("text"))
    return rounded(events.select("event_id", "text", parse_time(F.col("text")).alias("at")))


def s04_exchange_time(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "Datetime", exchange_time(F.col("Datetime")).alias("local_time")))


def s05_round_prices(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", round_price(F.col("value") / 8).alias("price"))


def s06_tag(spark, sf_dir):
    """Each symbol's bars tagged with a name of its own."""
    return rounded(source.tag(hourly(spark, sf_dir), F.concat(F.upper("symbol"), F.lit(".X"))))


def s07_flatten_names(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return rounded(source.flatten_names(bars.toDF(*[f"{c}/X" if c != "symbol" else c for c in bars.columns])))


def s06_tag_all(spark, sf_dir):
    return rounded(source.tag(hourly(spark, sf_dir).drop("symbol"), "ALL.X"))


def s07_flatten_all_names(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return rounded(source.flatten_names(bars.toDF(*[f"{c}/all" if c != "symbol" else c for c in bars.columns])))


def s08_write_bars(spark, sf_dir):
    return written(spark, hourly(spark, sf_dir))


def written(spark, df):
    path = source.new_path(spark)
    source.write(df, path)
    return rounded(source.read_table(spark, path).select(*df.columns))


def s10_feature_table_roundtrip(spark, sf_dir):
    table = job.all_columns(hourly(spark, sf_dir)).select("symbol", "position", "Datetime", "Close", "ma_20", "target_d")
    return written(spark, table)


def s09_feature_table_roundtrip(spark, sf_dir):
    """The whole feature table, written and read back."""
    return written(spark, features(spark, sf_dir))


def s10_symbols_as_text(spark, sf_dir):
    """Bars of symbols that look like numbers (0007), written by symbol and read back."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    named = events.withColumn("event_type", F.lpad((F.col("user_id") % 12).cast("string"), 4, "0")).withColumn("ts", F.col("ts").cast("timestamp"))
    return written(spark, source.select_bars(source.from_ticks(source.walk_ticks(named), "1 hour")))


def p06_pruned_symbol(spark, sf_dir):
    """One symbol from bars that were written by symbol: only its folder is read."""
    path = source.new_path(spark)
    source.write(hourly(spark, sf_dir), path)
    return rounded(source.one_symbol(spark, path, "purchase").select(*source.BAR_COLUMNS))


def p03_complete_rows(spark, sf_dir):
    table = candle_features(numbered(spark, sf_dir)).na.drop("any")
    return table.groupBy("symbol").agg(F.count("*").alias("n"), F.min("position").alias("first_position"), F.max("position").alias("last_position"))


def p04_rows_with_targets(spark, sf_dir):
    table = targets(numbered(spark, sf_dir)).na.drop(subset=["future_max_high", "target_d", "target_p"])
    return table.groupBy("symbol").agg(F.count("*").alias("n"))


def p06_one_symbol(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).where(F.col("symbol") == "purchase").orderBy("Datetime"))


def j01_without_bars(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower("n_name").alias("symbol"))
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol")).distinct()
    return source.without_bars(asked.union(kinds), hourly(spark, sf_dir))


def a01_summary(spark, sf_dir):
    return source.summary(hourly(spark, sf_dir))


def a02_symbols(spark, sf_dir):
    return source.symbols(hourly(spark, sf_dir))


def u01_stack(spark, sf_dir):
    """A frame for each letter that symbols begin with, and one for the others."""
    bars = source.kept(hourly(spark, sf_dir))
    letter = F.coalesce(F.lower(F.substring("symbol", 1, 1)), F.lit(""))
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    return rounded(source.stack([*[bars.where(letter == x) for x in letters], bars.where(~letter.isin(letters))]))


def u01_stack_all(spark, sf_dir):
    """Two frames that together hold every symbol, whatever the symbols are."""
    bars = hourly(spark, sf_dir)
    half = F.pmod(F.xxhash64("symbol"), F.lit(2))
    return rounded(source.stack([bars.where(half == k) for k in (0, 1)]))


def x01_ordinals(spark, sf_dir):
    return rounded(ordinals(hourly(spark, sf_dir), whole=True).select("symbol", "Datetime", "position", "global_position"))


def x01_ordinals_with_nulls(spark, sf_dir):
    """Ordinals where one symbol is null and one day holds a third of the bars."""
    bars = numbered(spark, sf_dir).drop("global_position")
    packed = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("position"))
    bars = bars.select(F.when(F.col("symbol") != "error", F.col("symbol")).alias("symbol"), F.when(F.col("position") % 3 == 0, packed).otherwise(F.col("Datetime")).alias("Datetime"), "Close")
    return rounded(ordinals(bars, whole=True).select("symbol", "Datetime", "Close", "position", "global_position"))


def c11_base_symbol(spark, sf_dir):
    names = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".ns").otherwise(""))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower(names).alias("symbol"))
    return nation.select("symbol", base_symbol(F.col("symbol")).alias("base_symbol"))


def c12_default_symbol(spark, sf_dir):
    return chart.default_symbol(hourly(spark, sf_dir).withColumn("symbol", F.concat("symbol", F.lit(".x"))), "view")


def c14_epoch(spark, sf_dir):
    return rounded(hourly(spark, sf_dir).select("symbol", "Datetime", epoch_seconds(F.col("Datetime")).alias("time")))


# ---------------------------------------------------------------- structure


def m01_swings(spark, sf_dir):
    return marked(spark, sf_dir).where("swing_high = 1 or swing_low = 1").select("symbol", "position", "swing_high", "swing_low")


def m02_strength(spark, sf_dir):
    return rounded(marked(spark, sf_dir).select("symbol", "position", "high_strength", "low_strength", "local_volatility"))


def m04_rejections(spark, sf_dir):
    return structure.pivots(marked(spark, sf_dir)).select("symbol", "side", "position", "rejections")


def m05_pivot_base(spark, sf_dir):
    return rounded(structure.pivots(marked(spark, sf_dir)).select("symbol", "side", "position", "price", "base"))


def m06_anchors(spark, sf_dir):
    return rounded(anchored(spark, sf_dir)[1].drop("stale"))


def j03_pairs(spark, sf_dir):
    return rounded(paired(spark, sf_dir)[1].select("symbol", "side", "first_pos", "second_pos", "span", "persistence", "slope", "normalized_slope"))


def m07_projection(spark, sf_dir):
    pair = paired(spark, sf_dir)[1]
    at = F.col("second_pos") + 12
    value = structure.projected(F.col("first_pos"), F.col("first_price"), F.col("second_pos"), F.col("second_price"), at)
    return rounded(pair.select("symbol", "side", "first_pos", "second_pos", at.alias("at"), value.alias("value")))


def a11_line_facts(spark, sf_dir):
    bars, pair = paired(spark, sf_dir)
    return rounded(structure.line_facts(pair, bars).select("symbol", "side", "first_pos", "second_pos", "price_span", "touches", "rejections", "body_violations"))


def m08_lines(spark, sf_dir):
    bars, pair = paired(spark, sf_dir)
    return rounded(structure.lines(pair, bars).select("symbol", "side", "first_pos", "first_price", "second_pos", "second_price", "score"))


def m09_usable_pairs(spark, sf_dir):
    bars, pair = paired(spark, sf_dir)
    return structure.lines(pair, bars).select("symbol", "side", "first_pos", "second_pos", "usable_from", F.coalesce("stale", F.lit(-1)).alias("stale"))


def m10_active_lines(spark, sf_dir):
    bars, pair = paired(spark, sf_dir)
    return rounded(structure.active_lines(bars, structure.lines(pair, bars)))


def m11_distances(spark, sf_dir):
    return rounded(with_lines(spark, sf_dir).select("symbol", "position", "distance_to_anchored_support", "distance_to_anchored_resistance"))


def m12_breakouts(spark, sf_dir):
    return with_lines(spark, sf_dir).where("anchored_breakout = 1 or anchored_breakdown = 1 or failed_breakdown = 1").select("symbol", "position", "anchored_breakout", "anchored_breakdown", "failed_breakdown")


def f02_feature_table(spark, sf_dir):
    return rounded(features(spark, sf_dir))


def p02_model_table(spark, sf_dir):
    return rounded(job.model_table(features(spark, sf_dir)))


def halo_chunks(spark, sf_dir):
    """Candle features and targets of 15-minute bars, computed in chunks with a halo."""
    bars = ordinals(source.kept(source.select_bars(source.from_ticks(ticks(spark, sf_dir), "15 minutes"))))
    apply = lambda b, keys: targets(candle_features(b, keys), keys)
    return rounded(in_chunks(bars, apply, 512).select("symbol", "position", "return_1", "atr_14", "adx_14", "high_volatility_market", "trend_slope_100", "ma_100", "rolling_higher_highs", "bullish_cross_50_100", "target_d", "target_p"))


# ---------------------------------------------------------------- metrics and models


def a03_class_distribution(spark, sf_dir):
    return metrics.class_distribution(targets(numbered(spark, sf_dir)))


def a04_class_weights(spark, sf_dir):
    return rounded(metrics.balanced_weights(predictions(spark, sf_dir).where("part = 'train'"), "actual_d"))


def a05_accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(predictions(spark, sf_dir)))


def a06_class_report(spark, sf_dir):
    return rounded(metrics.class_report(predictions(spark, sf_dir).where("part = 'test'")))


def a07_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir).where("part = 'test'"))


def a08_regression(spark, sf_dir):
    return rounded(metrics.regression(predictions(spark, sf_dir)))


def a10_diagnosis(spark, sf_dir):
    return rounded(metrics.diagnosis(predictions(spark, sf_dir)))


def d01_split(spark, sf_dir):
    return model.split(hourly(spark, sf_dir)).groupBy("symbol", "part").agg(F.count("*").alias("n"))


def d01_split_by_time(spark, sf_dir):
    return model.split(hourly(spark, sf_dir), by_time=True).groupBy("symbol", "part").agg(F.count("*").alias("n"))


def trained(spark, sf_dir):
    rows = source.kept(model.split(job.model_table(features(spark, sf_dir))))
    return model.fit(rows.where("part = 'train'"), job.FEATURE_COLUMNS), rows


def d05_predictions(spark, sf_dir):
    models, rows = trained(spark, sf_dir)
    return rounded(model.predict(models, rows, job.FEATURE_COLUMNS))


def d06_importances(spark, sf_dir):
    return rounded(model.importances(trained(spark, sf_dir)[0], job.FEATURE_COLUMNS, spark))


def softmax_trees(spark, sf_dir):
    rows = source.kept(model.split(job.model_table(features(spark, sf_dir))))
    return boosting.fit(rows.where("part = 'train'"), job.FEATURE_COLUMNS), rows


def d04_softmax_predictions(spark, sf_dir):
    """The result table of trees that are grown for all classes at once."""
    return rounded(boosting.predict(*softmax_trees(spark, sf_dir)))


def d06_gain_importances(spark, sf_dir):
    return rounded(boosting.importances(softmax_trees(spark, sf_dir)[0], spark))


def k03_top_importances(spark, sf_dir):
    return d06_importances(spark, sf_dir).orderBy(F.desc("importance"), "feature").limit(20)


def k04_first_predictions(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).orderBy("symbol", "position").limit(20))


# ---------------------------------------------------------------- chart


def n01_records(spark, sf_dir):
    found = records(spark, sf_dir)
    return rounded(found.withColumns({c: F.col(c).cast("double") for c in found.columns if c.endswith(("1Position", "2Position"))}))


def k01_in_order(spark, sf_dir):
    return rounded(source.in_order(hourly(spark, sf_dir)))


def k02_last_candles(spark, sf_dir):
    return rounded(chart.last_candles(numbered(spark, sf_dir), 100).select("symbol", "position", "Close"))


def k05_latest_anchors(spark, sf_dir):
    return rounded(chart.latest_anchors(visible(spark, sf_dir)))


def n02_payload(spark, sf_dir):
    """The whole payload, numbers rounded as in the other queries."""
    return chart.payload_json(source.kept(with_lines(spark, sf_dir)), "view", clean=rounded)


def n02_payload_json(spark, sf_dir):
    """The pages of the payload's series alone, with their numbers of records."""
    series = n02_payload(spark, sf_dir).where("field = 'series'")
    return series.select("symbol", "page", F.json_array_length("json").cast("long").alias("n_rows"), "json")


def s11_chart_rows(spark, sf_dir):
    """The chart's rows of all symbols, written as JSON and read back."""
    path = source.new_path(spark)
    write_chart(with_lines(spark, sf_dir), path)
    kinds = ", ".join(f"{c} {'boolean' if c in FLAGS else 'double' if c in DOUBLES else 'long'}" for c in ("time", *DOUBLES, *FLAGS, *PLACES_OF_ANCHORS))
    return rounded(spark.read.schema(f"{kinds}, symbol string").json(path).select("symbol", "time", *DOUBLES, *FLAGS, *PLACES_OF_ANCHORS))


FLAGS = ("swingHigh", "swingLow", "anchoredBreakout", "anchoredBreakdown")
DOUBLES = ("open", "high", "low", "close", "volume", *(f"{s}Anchor{i}Price" for s in chart.SIDES for i in (1, 2)))
PLACES_OF_ANCHORS = tuple(f"{s}Anchor{i}Position" for s in chart.SIDES for i in (1, 2))


def p05_missing_columns(spark, sf_dir):
    """For each symbol's bars, the columns of the chart that they lack."""
    bars = hourly(spark, sf_dir)
    lacking = source.missing(bars, chart.REQUIRED)
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.lit(",".join(lacking)).alias("missing"))


def p07_empty_symbols(spark, sf_dir):
    """Which of the symbols asked for the guard against empty input would refuse."""
    asked = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lower("n_name").alias("symbol"))
    bars = source.kept(hourly(spark, sf_dir))
    return source.guarded(asked.union(bars.select("symbol").distinct()), bars)


def n03_candles(spark, sf_dir):
    return rounded(chart.candles(visible(spark, sf_dir)))


def n04_rays(spark, sf_dir):
    return rounded(chart.rays(visible(spark, sf_dir)))


def u02_markers(spark, sf_dir):
    return chart.markers(visible(spark, sf_dir))


#: Candle columns by query.
CANDLES = {
    "w01_momentum": ["momentum"], "w02_return": ["return_1"], "w03_avg_volume": ["avg_volume"], "w04_volatility": ["volatility"],
    "w05_true_range": ["tr"], "w06_atr": ["atr_14"], "w07_directional_movement": ["plus_dm", "minus_dm"],
    "w08_directional_index": ["plus_di", "minus_di", "dx"], "w09_adx": ["adx_14"],
    "w10_trend_regime": ["trending_market", "ranging_market"], "w11_volatility_regime": ["high_volatility_market", "low_volatility_market"],
    "w12_rolling_momentum": ["rolling_avg_momentum"], "w13_compression": ["compression_width"],
    "w14_sequences": ["bearish_sequence_strength", "bullish_sequence_strength"], "w15_volatility_expansion": ["volatility_expansion"],
    "w16_pivot_mean": ["pivot_mean"], "w17_trend_slopes": ["trend_slope_50", "trend_slope_100"], "w18_moving_averages": ["ma_20", "ma_50", "ma_100"],
    "w19_crosses": ["bullish_cross_20_50", "bearish_cross_20_50", "bullish_cross_50_100", "bearish_cross_50_100"],
    "w20_highs_and_lows": ["rolling_higher_highs", "rolling_lower_lows"], "w21_persistence": ["directional_persistence"],
    "c01_body_mid": ["body_mid"], "c02_volume_spike": ["volume_spike"], "c03_directional_volume": ["directional_volume"], "c04_atr_ratio": ["atr_ratio"],
    "c05_wicks": ["lower_wick", "upper_wick"], "c06_wick_ratio": ["wick_ratio"], "c07_pivot_distance": ["pivot_distance"],
    "c08_cross_distances": ["ma_cross_distance_20_50", "ma_cross_distance_50_100"], "c09_equilibrium": ["equilibrium_trend_distance"],
    "t01_future_range": ["future_max_high", "future_min_low"], "t02_future_returns": ["future_max_return", "future_min_return"],
    "t03_target_class": ["target_d"], "t04_target_return": ["target_p"],
}


def crossings(spark, sf_dir):
    """Where each symbol's 20-bar mean crosses its 50-bar mean."""

    def apply(bars, keys):
        f = Frames(keys)
        means = bars.withColumns({"ma_20": f.roll(F.avg, F.col("Close"), 20), "ma_50": f.roll(F.avg, F.col("Close"), 50)})
        return means.withColumns({"up": f.crosses("ma_20", "ma_50", True), "down": f.crosses("ma_20", "ma_50", False)})

    means = in_chunks(numbered(spark, sf_dir), apply)
    return rounded(means.where("up = 1 or down = 1").select("symbol", "Datetime", "position", "ma_20", "ma_50", "up", "down"))


QUERIES = {name: candle_query(*columns) for name, columns in CANDLES.items()} | {
    f.__name__: f
    for f in (
        crossings, s01_read_bars, s01_named_csv, s01_refused_rows, s02_bars_from_ticks, s02_recent_bars, s03_parse_times, s04_exchange_time, s05_round_prices, s06_tag, s06_tag_all,
        s07_flatten_names, s07_flatten_all_names, s08_write_bars, s09_feature_table_roundtrip, s10_feature_table_roundtrip, s10_symbols_as_text, p06_pruned_symbol, x01_ordinals_with_nulls, p02_model_table, p03_complete_rows, p04_rows_with_targets, p06_one_symbol,
        j01_without_bars, a01_summary, a02_symbols, u01_stack, u01_stack_all, x01_ordinals, c11_base_symbol, c12_default_symbol, c14_epoch, m01_swings,
        m02_strength, m04_rejections, m05_pivot_base, m06_anchors, j03_pairs, m07_projection, a11_line_facts, m08_lines, m09_usable_pairs,
        m10_active_lines, m11_distances, m12_breakouts, f02_feature_table, halo_chunks, a03_class_distribution, a04_class_weights, a05_accuracy,
        a06_class_report, a07_confusion, a08_regression, a10_diagnosis, d01_split, d01_split_by_time, d04_softmax_predictions, d05_predictions, d06_importances, d06_gain_importances, k03_top_importances,
        k04_first_predictions, n01_records, k01_in_order, k02_last_candles, k05_latest_anchors, n02_payload, n02_payload_json, s11_chart_rows, p05_missing_columns, p07_empty_symbols, n03_candles, n04_rays, u02_markers,
    )
}
