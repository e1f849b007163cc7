"""DuckDB SQL for the candle queries, on the same parquet tables."""

from __future__ import annotations

from .operators.chart import REQUIRED
from .plans.features import FEATURE_COLUMNS
from .queries import CANDLES, PLACES
from .sources.bars import BAR_COLUMNS

BARS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id, 1 + event_id % 97 AS volume,
         ((2000000 + CAST(SUM(CAST(ROUND(value * 100) AS BIGINT) - 5000)
             OVER (PARTITION BY event_type ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT))
           // 20) / CAST(100 AS DOUBLE) AS price
  FROM events),
bars AS (
  SELECT {bucket} AS Datetime, arg_min(price, row(ts, event_id)) AS Open, MAX(price) AS High,
         MIN(price) AS Low, arg_max(price, row(ts, event_id)) AS Close,
         CAST(SUM(volume) AS BIGINT) AS Volume, symbol
  FROM ticks GROUP BY symbol, {bucket}),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY Datetime) - 1 AS BIGINT) AS position FROM bars)"""
HOURLY = BARS.format(bucket="date_trunc('hour', ts)")
QUARTERS = BARS.format(bucket="time_bucket(INTERVAL 15 MINUTE, ts)")

W = "PARTITION BY symbol ORDER BY Datetime"


def over(first: str, last: str) -> str:
    return f"OVER ({W} ROWS BETWEEN {first} AND {last})"


def back(n: int) -> str:
    return over(f"{n - 1} PRECEDING", "CURRENT ROW")


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {back(n)} = {n} THEN {agg}({x}) {back(n)} END"


def ahead(agg: str, x: str) -> str:
    frame = over("1 FOLLOWING", "12 FOLLOWING")
    return f"CASE WHEN count({x}) {frame} = 12 THEN {agg}({x}) {frame} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def crosses(a: str, b: str, up: bool) -> str:
    return flag(f"{lag(a)} {'<=' if up else '>='} {lag(b)} AND {a} {'>' if up else '<'} {b}")


CANDLE_STEPS = f"""f1 AS (SELECT *, (Open + Close) / 2 AS body_mid, (Close - Open) * Volume AS directional_volume,
    least(Open, Close) - Low AS lower_wick, High - greatest(Open, Close) AS upper_wick,
    Close - {lag("Close", 8)} AS momentum, Close / nullif({lag("Close")}, 0) - 1 AS return_1, {roll("avg", "Volume", 20)} AS avg_volume,
    greatest(High - Low, abs(High - {lag("Close")}), abs(Low - {lag("Close")})) AS tr,
    High - {lag("High")} AS up, {lag("Low")} - Low AS down,
    {roll("max", "High", 20)} - {roll("min", "Low", 20)} AS compression_width,
    CASE WHEN Close < Open THEN 1 ELSE 0 END AS falls, CASE WHEN Close > Open THEN 1 ELSE 0 END AS rises,
    CASE WHEN High > {lag("High")} THEN 1 ELSE 0 END AS higher, CASE WHEN Low < {lag("Low")} THEN 1 ELSE 0 END AS lower_low,
    {roll("avg", "Close", 20)} AS pivot_mean, {roll("avg", "Close", 20)} AS ma_20, {roll("avg", "Close", 50)} AS ma_50, {roll("avg", "Close", 100)} AS ma_100,
    CASE WHEN count(Close) {back(50)} = 50 THEN regr_slope(Close, position) {back(50)} END AS trend_slope_50,
    CASE WHEN count(Close) {back(100)} = 100 THEN regr_slope(Close, position) {back(100)} END AS trend_slope_100,
    {ahead("max", "High")} AS future_max_high, {ahead("min", "Low")} AS future_min_low FROM b),
f2 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus_dm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus_dm,
    lower_wick / (upper_wick + 1e-9) AS wick_ratio, Volume / nullif(avg_volume, 0) AS volume_spike, {roll("stddev_samp", "return_1", 10)} AS volatility,
    {roll("avg", "tr", 14)} AS atr_14, {roll("avg", "momentum", 10)} AS rolling_avg_momentum, (Close - pivot_mean) / nullif(Close, 0) AS pivot_distance,
    CAST({roll("sum", "falls", 5)} AS DOUBLE) AS bearish_sequence_strength, CAST({roll("sum", "rises", 5)} AS DOUBLE) AS bullish_sequence_strength,
    CAST({roll("sum", "higher", 20)} AS DOUBLE) AS rolling_higher_highs, CAST({roll("sum", "lower_low", 20)} AS DOUBLE) AS rolling_lower_lows,
    {roll("avg", "sign(return_1)", 20)} AS directional_persistence,
    {crosses("ma_20", "ma_50", True)} AS bullish_cross_20_50, {crosses("ma_20", "ma_50", False)} AS bearish_cross_20_50,
    {crosses("ma_50", "ma_100", True)} AS bullish_cross_50_100, {crosses("ma_50", "ma_100", False)} AS bearish_cross_50_100,
    (ma_20 - ma_50) / nullif(Close, 0) AS ma_cross_distance_20_50, (ma_50 - ma_100) / nullif(Close, 0) AS ma_cross_distance_50_100,
    (future_max_high - Close) / nullif(Close, 0) AS future_max_return, (future_min_low - Close) / nullif(Close, 0) AS future_min_return FROM f1),
f3 AS (SELECT *, 100 * ({roll("sum", "plus_dm", 14)}) / (({roll("sum", "tr", 14)}) + 1e-9) AS plus_di, 100 * ({roll("sum", "minus_dm", 14)}) / (({roll("sum", "tr", 14)}) + 1e-9) AS minus_di,
    atr_14 / nullif(Close, 0) AS atr_ratio, volatility / nullif({roll("avg", "volatility", 20)}, 0) AS volatility_expansion,
    pivot_distance * directional_persistence AS equilibrium_trend_distance,
    CASE WHEN future_max_return > abs(future_min_return) AND future_max_return > 0.0045 THEN 2 WHEN abs(future_min_return) > future_max_return AND abs(future_min_return) > 0.0045 THEN 0 ELSE 1 END AS target_d FROM f2),
f4 AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-9) AS dx,
    CASE target_d WHEN 2 THEN future_max_return WHEN 0 THEN future_min_return ELSE 0.0 END AS target_p FROM f3),
f5 AS (SELECT *, {roll("avg", "dx", 14)} AS adx_14, {roll("median", "atr_ratio", 100)} AS mid FROM f4),
f AS (SELECT *, {flag("adx_14 > 25")} AS trending_market, {flag("adx_14 < 20")} AS ranging_market, {flag("atr_ratio > mid")} AS high_volatility_market, {flag("atr_ratio < mid")} AS low_volatility_market FROM f5)"""

WHOLE = {
    "trending_market", "ranging_market",
    "high_volatility_market", "low_volatility_market", "target_d", "bullish_cross_20_50", "bearish_cross_20_50", "bullish_cross_50_100", "bearish_cross_50_100",
}


def six(*columns: str) -> str:
    return ", ".join(c if c in WHOLE else f"round({c}, {PLACES.get(c, 6)}) + 0.0 AS {c}" for c in columns)


PRICES = six("Open", "High", "Low", "Close")
BAR_ROW = f"Datetime, {PRICES}, Volume, symbol"


def candle_sql(*columns: str) -> str:
    return f"WITH {HOURLY}, {CANDLE_STEPS} SELECT symbol, position, {six(*columns)} FROM f"


def bars_sql(select: str, steps: str = "", source: str = HOURLY) -> str:
    return f"WITH {source}{', ' + steps if steps else ''} {select}"


K3, A3 = over("3 PRECEDING", "1 PRECEDING"), over("1 FOLLOWING", "3 FOLLOWING")
SWINGS = f"""s0 AS (SELECT *, max(High) {K3} AS h1, max(High) {A3} AS h2, min(Low) {K3} AS l1, min(Low) {A3} AS l2,
    count(*) {K3} AS n1, count(*) {A3} AS n2, avg(High - Low) {over("20 PRECEDING", "CURRENT ROW")} / greatest(abs(Close), 1e-9) AS local_volatility FROM b),
s AS (SELECT *, {flag("n1 = 3 AND n2 = 3 AND High > h1 AND High > h2")} AS swing_high, {flag("n1 = 3 AND n2 = 3 AND Low < l1 AND Low < l2")} AS swing_low,
    (High - greatest(h1, h2)) / greatest(abs(Close), 1e-9) AS high_strength, (least(l1, l2) - Low) / greatest(abs(Close), 1e-9) AS low_strength FROM s0)"""
PIVOTS = f"""{SWINGS},
p0 AS (SELECT symbol, position, 'support' AS side, Low AS price, Close AS pc, local_volatility, low_strength AS strength FROM s WHERE swing_low = 1
       UNION ALL SELECT symbol, position, 'resistance', High, Close, local_volatility, high_strength FROM s WHERE swing_high = 1),
rej AS (SELECT p0.symbol, p0.side, p0.position, CAST(sum(CASE WHEN side = 'support' AND abs(b.Low - price) <= pc * 0.0035 AND b.Close > b.Low THEN 1
        WHEN side = 'resistance' AND abs(b.High - price) <= pc * 0.0035 AND b.Close < b.High THEN 1 ELSE 0 END) AS BIGINT) AS rejections
        FROM p0 JOIN b ON b.symbol = p0.symbol AND b.position BETWEEN p0.position - 24 AND p0.position + 24 GROUP BY ALL),
p AS (SELECT p0.*, rejections, strength / greatest(local_volatility, 1e-9) * 0.75 + least(rejections, 5) * 0.18 AS base
      FROM p0 JOIN rej USING (symbol, side, position))"""
ANCHORS = f"""{PIVOTS},
q AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY position) AS k FROM p),
walk AS (
  SELECT symbol, side, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS last, CAST(NULL AS DOUBLE) AS score, false AS taken FROM (SELECT DISTINCT symbol, side FROM q)
  UNION ALL
  SELECT w.symbol, w.side, q.k, CASE WHEN t.ok THEN q.position ELSE w.last END, t.score, t.ok
  FROM walk w JOIN q ON q.symbol = w.symbol AND q.side = w.side AND q.k = w.k + 1,
  LATERAL (SELECT q.base + (CASE WHEN w.last IS NULL THEN 1.0 ELSE least((q.position - w.last) / 16.0, 2.5) END) * 0.25 AS score,
                  (w.last IS NULL OR q.position - w.last >= 10) AND q.base + (CASE WHEN w.last IS NULL THEN 1.0 ELSE least((q.position - w.last) / 16.0, 2.5) END) * 0.25 >= 0.85 AS ok) t),
anchors AS (SELECT q.symbol, q.side, q.position, q.price, w.score FROM walk w JOIN q USING (symbol, side, k) WHERE taken)"""
PAIRS = f"""{ANCHORS},
ends AS (SELECT symbol, max(position) AS last_pos FROM b GROUP BY symbol),
pr0 AS (SELECT a.symbol, a.side, a.position AS first_pos, a.price AS first_price, a.score AS first_score, c.position AS second_pos, c.price AS second_price, c.score AS second_score,
        c.position - a.position AS span, last_pos - c.position AS persistence, (c.price - a.price) / (c.position - a.position) AS slope,
        abs((c.price - a.price) / (c.position - a.position)) / greatest(abs(c.price), 1e-9) AS normalized_slope
        FROM anchors a JOIN anchors c ON a.symbol = c.symbol AND a.side = c.side AND c.position - a.position BETWEEN 28 AND 180 JOIN ends ON ends.symbol = a.symbol),
pairs AS (SELECT * FROM pr0 WHERE persistence >= 12 AND normalized_slope <= 0.0022 AND first_score + second_score >= 0.85)"""
LINES = f"""{PAIRS},
along AS (SELECT r.symbol, side, first_pos, second_pos, High, Low, Close, Close * 0.0035 AS tol,
          second_price + (second_price - first_price) / (second_pos - first_pos) * (position - second_pos) AS line
          FROM pairs r JOIN b ON b.symbol = r.symbol AND b.position BETWEEN first_pos AND second_pos),
met AS (SELECT *, abs(CASE side WHEN 'support' THEN Low ELSE High END - line) <= tol AS touched, CASE side WHEN 'support' THEN Close > line ELSE Close < line END AS inside,
        CASE side WHEN 'support' THEN Close < line - tol ELSE Close > line + tol END AS violated FROM along),
facts AS (SELECT symbol, side, first_pos, second_pos, max(High) - min(Low) AS price_span, count(*) FILTER (touched) AS touches,
          count(*) FILTER (touched AND inside) AS rejections, count(*) FILTER (violated) AS body_violations FROM met GROUP BY ALL),
li AS (SELECT r.*, price_span, touches, rejections, body_violations, abs(second_price - first_price) / nullif(price_span, 0) AS vertical
       FROM pairs r JOIN facts USING (symbol, side, first_pos, second_pos)),
lines AS (SELECT *, least(span, 220) * 2.5 + (touches * 22.0 + rejections * 18.0) + least(persistence, 120) * 0.6 + (first_score + second_score) * 30.0
          + CASE WHEN (side = 'support' AND slope > 0) OR (side = 'resistance' AND slope < 0) THEN 35.0 ELSE 0.0 END - (normalized_slope * 14000.0 + vertical * 45.0) - body_violations * 8.0 AS score
          FROM li WHERE price_span > 0 AND abs(slope) <= price_span / span AND vertical <= 0.65 AND touches >= 2 AND rejections >= 2 AND body_violations / span <= 0.25),
usable AS (SELECT l.*, second_pos + 3 AS usable_from, (SELECT min(a.position) + 3 FROM anchors a WHERE a.symbol = l.symbol AND a.side = l.side AND a.position > l.first_pos + 180) AS stale FROM lines l)"""

PREDICTIONS = f"""{CANDLE_STEPS},
rows0 AS (SELECT symbol, Datetime, position, target_d, target_p, return_1, row_number() OVER (ORDER BY symbol, Datetime) - 1 AS g, count(*) OVER () AS n FROM f WHERE return_1 IS NOT NULL),
pred AS (SELECT symbol, Datetime, position, CASE WHEN g < n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS part, target_d AS actual_d, CAST(position % 3 AS INTEGER) AS predicted_d,
         target_p AS actual_p, return_1 AS predicted_p FROM rows0),
acc AS (SELECT part, avg(CASE WHEN actual_d = predicted_d THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY part),
reg AS (SELECT part, avg(abs(actual_p - predicted_p)) AS mae, sqrt(avg((actual_p - predicted_p) ** 2)) AS rmse,
        1 - sum((actual_p - predicted_p) ** 2) / (var_pop(actual_p) * count(*)) AS r2 FROM pred GROUP BY part)"""
REPORT = """t AS (SELECT * FROM pred WHERE part = 'test'),
labels AS (SELECT DISTINCT unnest([actual_d, predicted_d]) AS label FROM t),
c AS (SELECT label, count(*) FILTER (actual_d = label AND predicted_d = label) AS hit, count(*) FILTER (predicted_d = label) AS said, count(*) FILTER (actual_d = label) AS support
      FROM labels, t GROUP BY label),
c2 AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM c),
c3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c2),
c4 AS (SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM c3
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c3
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c3)"""

COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in sorted({c for columns in CANDLES.values() for c in columns} - {"future_max_high", "future_min_low", "future_max_return", "future_min_return", "target_d", "target_p"}))
KEY = "symbol, side, first_pos, second_pos"

ORACLES = {name: candle_sql(*columns) for name, columns in CANDLES.items()} | {
    "crossings": bars_sql(f"SELECT symbol, Datetime, position, {six('ma_20', 'ma_50')}, bullish_cross_20_50 AS up, bearish_cross_20_50 AS down FROM f WHERE bullish_cross_20_50 = 1 OR bearish_cross_20_50 = 1", CANDLE_STEPS),
    "s01_read_bars": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "s01_named_csv": bars_sql(f"SELECT Datetime, CASE WHEN position % 50 <> 29 THEN round(Open, 6) + 0.0 END AS Open, {six('High', 'Low', 'Close')}, Volume, symbol FROM b WHERE position % 50 NOT IN (7, 13, 21)"),
    "s01_refused_rows": bars_sql(f"SELECT symbol, CASE WHEN position % 50 <> 13 THEN Datetime END AS Datetime, {six('High')}, CASE WHEN position % 50 <> 7 THEN round(Close, 6) + 0.0 END AS Close, CASE WHEN position % 50 <> 21 THEN Volume END AS Volume, CASE position % 50 WHEN 7 THEN 'Close' WHEN 13 THEN 'Datetime' ELSE 'Volume' END AS refused FROM b WHERE position % 50 IN (7, 13, 21)"),
    "s02_bars_from_ticks": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "s02_recent_bars": bars_sql(f"SELECT {BAR_ROW} FROM bars WHERE Datetime >= (SELECT max(ts) FROM ticks) - INTERVAL 7 DAY", source=QUARTERS),
    "s03_parse_times": """WITH t AS (SELECT event_id, date_trunc('second', ts) AS s FROM events)
SELECT event_id, strftime(s, '%Y-%m-%d %H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '+05:30' ELSE '' END AS text,
       CASE WHEN event_id % 2 = 0 THEN s - INTERVAL '330 minutes' ELSE s END AS at FROM t""",
    "s04_exchange_time": bars_sql("SELECT symbol, Datetime, Datetime + INTERVAL '330 minutes' AS local_time FROM bars"),
    "s05_round_prices": "SELECT event_id, round_even(value / 8 * 100, 0) / 100 AS price FROM events",
    "s06_tag": bars_sql(f"SELECT Datetime, {PRICES}, Volume, upper(symbol) || '.X' AS symbol FROM bars"),
    "s06_tag_all": bars_sql(f"SELECT Datetime, {PRICES}, Volume, 'ALL.X' AS symbol FROM bars"),
    "s07_flatten_names": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "s07_flatten_all_names": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "s08_write_bars": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "s10_feature_table_roundtrip": bars_sql(f"SELECT symbol, position, Datetime, {six('Close', 'ma_20')}, target_d FROM f", CANDLE_STEPS),
    "s10_symbols_as_text": bars_sql(f"SELECT {BAR_ROW} FROM bars", source=HOURLY.replace("event_type", "lpad(CAST(user_id % 12 AS VARCHAR), 4, '0')")),
    "p06_pruned_symbol": bars_sql(f"SELECT {BAR_ROW} FROM bars WHERE symbol = 'purchase'"),
    "x01_ordinals_with_nulls": bars_sql("""SELECT symbol, Datetime, round(Close, 6) + 0.0 AS Close, row_number() OVER (PARTITION BY symbol ORDER BY Datetime) - 1 AS position,
       row_number() OVER (ORDER BY symbol NULLS FIRST, Datetime) - 1 AS global_position
FROM (SELECT nullif(symbol, 'error') AS symbol, CASE WHEN position % 3 = 0 THEN make_timestamp((1700000000 + position) * 1000000) ELSE Datetime END AS Datetime, Close FROM b)"""),
    "p03_complete_rows": bars_sql(f"SELECT symbol, count(*) AS n, min(position) AS first_position, max(position) AS last_position FROM f WHERE {COMPLETE} GROUP BY symbol", CANDLE_STEPS),
    "p04_rows_with_targets": bars_sql("SELECT symbol, count(*) AS n FROM f WHERE future_max_high IS NOT NULL GROUP BY symbol", CANDLE_STEPS),
    "p06_one_symbol": bars_sql(f"SELECT {BAR_ROW} FROM bars WHERE symbol = 'purchase'"),
    "j01_without_bars": "SELECT lower(n_name) AS symbol FROM nation WHERE lower(n_name) NOT IN (SELECT event_type FROM events)",
    "a01_summary": bars_sql("SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM bars"),
    "a02_symbols": "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type IS NOT NULL",
    "u01_stack": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "u01_stack_all": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "p05_missing_columns": bars_sql(f"SELECT symbol, count(*) AS n, '{','.join(c for c in REQUIRED if c not in BAR_COLUMNS)}' AS missing FROM bars GROUP BY symbol"),
    "p07_empty_symbols": bars_sql("SELECT a.symbol, coalesce(n, 0) AS n, n IS NULL AS empty FROM (SELECT lower(n_name) AS symbol FROM nation UNION SELECT symbol FROM bars) a LEFT JOIN (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) c ON c.symbol = a.symbol"),
    "x01_ordinals": bars_sql("SELECT symbol, Datetime, position, row_number() OVER (ORDER BY symbol, Datetime) - 1 AS global_position FROM b"),
    "c11_base_symbol": "SELECT s AS symbol, split_part(upper(s), '.', 1) AS base_symbol FROM (SELECT lower(n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.ns' ELSE '' END) AS s FROM nation)",
    "c12_default_symbol": "SELECT event_type || '.x' AS symbol FROM events GROUP BY 1 ORDER BY symbol <> 'view.x', symbol LIMIT 1",
    "c14_epoch": bars_sql("SELECT symbol, Datetime, CAST(epoch(Datetime) AS BIGINT) AS time FROM bars"),
    "m01_swings": bars_sql("SELECT symbol, position, swing_high, swing_low FROM s WHERE swing_high = 1 OR swing_low = 1", SWINGS),
    "m02_strength": bars_sql(f"SELECT symbol, position, {six('high_strength', 'low_strength', 'local_volatility')} FROM s", SWINGS),
    "m04_rejections": bars_sql("SELECT symbol, side, position, rejections FROM p", PIVOTS),
    "m05_pivot_base": bars_sql(f"SELECT symbol, side, position, {six('price', 'base')} FROM p", PIVOTS),
    "m06_anchors": bars_sql(f"SELECT symbol, side, position, {six('price', 'score')} FROM anchors", ANCHORS).replace("WITH ", "WITH RECURSIVE ", 1),
    "j03_pairs": bars_sql(f"SELECT {KEY}, span, persistence, {six('slope', 'normalized_slope')} FROM pairs", PAIRS).replace("WITH ", "WITH RECURSIVE ", 1),
    "m07_projection": bars_sql(f"SELECT {KEY}, second_pos + 12 AS at, round(second_price + slope * 12, 6) + 0.0 AS value FROM pairs", PAIRS).replace("WITH ", "WITH RECURSIVE ", 1),
    "a11_line_facts": bars_sql(f"SELECT {KEY}, {six('price_span')}, touches, rejections, body_violations FROM facts", LINES).replace("WITH ", "WITH RECURSIVE ", 1),
    "m08_lines": bars_sql(f"SELECT {KEY}, {six('first_price', 'second_price', 'score')} FROM lines", LINES).replace("WITH ", "WITH RECURSIVE ", 1),
    "m09_usable_pairs": bars_sql(f"SELECT {KEY}, usable_from, coalesce(stale, -1) AS stale FROM usable", LINES).replace("WITH ", "WITH RECURSIVE ", 1),
    "halo_chunks": bars_sql(f"SELECT symbol, position, {six('return_1', 'atr_14', 'adx_14', 'high_volatility_market', 'trend_slope_100', 'ma_100', 'rolling_higher_highs', 'bullish_cross_50_100', 'target_d', 'target_p')} FROM f", CANDLE_STEPS, QUARTERS),
    "a03_class_distribution": bars_sql("SELECT target_d, count(*) AS count FROM f GROUP BY target_d", CANDLE_STEPS),
    "a04_class_weights": bars_sql("SELECT actual_d, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) + 0.0 AS weight FROM (SELECT actual_d, count(*) AS n FROM pred WHERE part = 'train' GROUP BY 1)", PREDICTIONS),
    "a05_accuracy": bars_sql(f"SELECT part, {six('accuracy')} FROM acc", PREDICTIONS),
    "a06_class_report": bars_sql(f"SELECT label, {six('precision', 'recall', 'f1')}, support FROM c4", f"{PREDICTIONS}, {REPORT}"),
    "a07_confusion": bars_sql("SELECT CAST(l AS INTEGER) AS actual_d, " + ", ".join(f"count(*) FILTER (part = 'test' AND actual_d = l AND predicted_d = {k}) AS predicted_{k}" for k in range(3)) + " FROM pred, range(3) r(l) GROUP BY l", PREDICTIONS),
    "a08_regression": bars_sql(f"SELECT part, {six('mae', 'rmse', 'r2')} FROM reg", PREDICTIONS),
    "a10_diagnosis": bars_sql("""SELECT round(tr.accuracy, 6) AS train_accuracy, round(rr.r2, 6) AS train_r2, round(te.accuracy, 6) AS test_accuracy, round(re.r2, 6) AS test_r2,
       CASE WHEN tr.accuracy - te.accuracy > 0.20 OR rr.r2 - re.r2 > 0.50 THEN 'Overfit' WHEN tr.accuracy < 0.50 AND te.accuracy < 0.50 THEN 'Underfit' ELSE 'Seems healthy' END AS diagnosis
FROM acc tr, acc te, reg rr, reg re WHERE tr.part = 'train' AND te.part = 'test' AND rr.part = 'train' AND re.part = 'test'""", PREDICTIONS),
    "d01_split": bars_sql("SELECT symbol, CASE WHEN g < n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM (SELECT symbol, row_number() OVER (ORDER BY symbol, Datetime) - 1 AS g, count(*) OVER () AS n FROM b) GROUP BY ALL"),
    "d01_split_by_time": bars_sql("SELECT symbol, CASE WHEN position < n - ceil(0.2 * n) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM (SELECT symbol, position, count(*) OVER (PARTITION BY symbol) AS n FROM b) GROUP BY ALL"),
    "k04_first_predictions": bars_sql(f"SELECT symbol, Datetime, position, part, actual_d, predicted_d, {six('actual_p', 'predicted_p')} FROM pred ORDER BY symbol, position LIMIT 20", PREDICTIONS),
    "k01_in_order": bars_sql(f"SELECT {BAR_ROW} FROM bars"),
    "k02_last_candles": bars_sql(f"SELECT symbol, position, {six('Close')} FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position DESC) <= 100"),
    "n03_candles": bars_sql(f"SELECT symbol, CAST(epoch(Datetime) AS BIGINT) AS time, {', '.join(f'round({c}, 6) + 0.0 AS {c.lower()}' for c in ('Open', 'High', 'Low', 'Close'))} FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position DESC) <= 200"),
}

# ---------------------------------------------------------------- the active line

ACTIVE = f"""{LINES},
cand AS (SELECT symbol, side, list({{'fp': first_pos, 'fv': first_price, 'sp': second_pos, 'sv': second_price, 'score': score, 'a': usable_from,
         'z': coalesce(stale, 9000000000), 'key': first_pos * 1000000000 + second_pos}} ORDER BY score DESC, second_pos DESC, first_pos DESC) AS c FROM usable GROUP BY symbol, side),
fold AS (
  SELECT symbol, side, CAST(-1 AS BIGINT) AS position, CAST(NULL AS DOUBLE) AS line, false AS alive, CAST(NULL AS BIGINT) AS fp, CAST(NULL AS DOUBLE) AS fv, CAST(NULL AS BIGINT) AS sp, CAST(NULL AS DOUBLE) AS sv,
         CAST(NULL AS BIGINT) AS key, CAST(NULL AS DOUBLE) AS base, CAST(NULL AS DOUBLE) AS score, 0 AS t, 0 AS r, 0 AS x, CAST(0 AS BIGINT) AS born, CAST(0 AS BIGINT) AS last, CAST([] AS BIGINT[]) AS retired FROM cand
  UNION ALL
  SELECT symbol, side, position, line, active AND NOT expired, fp, fv, sp, sv, key, base, score, t, r, x, born, last, CASE WHEN active AND expired THEN list_append(retired, key) ELSE retired END
  FROM (SELECT *, x >= 2 OR position - last > 48 OR score < 30.0 AS expired
    FROM (SELECT *, base + (t * 18.0 + r * 24.0) + least(position - born, 160) * 0.35 + greatest(24 - (position - last), 0) * 2.0 - greatest(position - last - 24, 0) * 4.0 - x * 55.0 AS score
      FROM (SELECT * EXCLUDE (t, r, x, last), t + CAST(coalesce(touched, false) AS INTEGER) AS t, r + CAST(coalesce(touched AND inside, false) AS INTEGER) AS r,
                   CASE WHEN broken THEN x + 1 ELSE 0 END AS x, CASE WHEN touched THEN position ELSE last END AS last
        FROM (SELECT *, abs(extreme - line) <= tol AS touched, CASE side WHEN 'support' THEN close > line ELSE close < line END AS inside,
                     CASE side WHEN 'support' THEN close < line - tol ELSE close > line + tol END AS broken
          FROM (SELECT *, CASE WHEN active THEN sv + (sv - fv) / (sp - fp) * (position - sp) END AS line
            FROM (SELECT symbol, side, position, extreme, close, tol, retired, alive OR adopt AS active,
                         CASE WHEN adopt THEN best.fp ELSE fp END AS fp, CASE WHEN adopt THEN best.fv ELSE fv END AS fv, CASE WHEN adopt THEN best.sp ELSE sp END AS sp, CASE WHEN adopt THEN best.sv ELSE sv END AS sv,
                         CASE WHEN adopt THEN best.key ELSE key END AS key, CASE WHEN adopt THEN best.score ELSE base END AS base,
                         CASE WHEN adopt THEN 0 ELSE t END AS t, CASE WHEN adopt THEN 0 ELSE r END AS r, CASE WHEN adopt THEN 0 ELSE x END AS x,
                         CASE WHEN adopt THEN position ELSE born END AS born, CASE WHEN adopt THEN position ELSE last END AS last
              FROM (SELECT *, best IS NOT NULL AND (NOT alive OR (best.key <> key AND best.score > score * 1.18)) AS adopt
                FROM (SELECT p.symbol, p.side, b.position, CASE p.side WHEN 'support' THEN b.Low ELSE b.High END AS extreme, b.Close AS close, b.Close * 0.0035 AS tol,
                             p.alive, p.fp, p.fv, p.sp, p.sv, p.key, p.base, p.score, p.t, p.r, p.x, p.born, p.last, p.retired,
                             list_filter(cand.c, lambda k: k.a <= b.position AND b.position < k.z AND NOT list_contains(p.retired, k.key))[1] AS best
                      FROM fold p JOIN b ON b.symbol = p.symbol AND b.position = p.position + 1 JOIN cand ON cand.symbol = p.symbol AND cand.side = p.side))))))))),
active AS (SELECT symbol, side, position, line, fp AS first_pos, fv AS first_price, sp AS second_pos, sv AS second_price FROM fold WHERE line IS NOT NULL)"""

_PARTS = [(s, i, n) for s in ("support", "resistance") for i, n in ((1, "first"), (2, "second"))]
_WIDE = ", ".join(
    [f"max(line) FILTER (side = '{s}') AS anchored_{s}" for s in ("support", "resistance")]
    + [f"max({n}_{c}) FILTER (side = '{s}') AS {s}_anchor_{i}_{name}" for s, i, n in _PARTS for c, name in (("pos", "position"), ("price", "price"))]
)
STRUCTURE = f"""{ACTIVE},
wide AS (SELECT symbol, position, {_WIDE} FROM active GROUP BY symbol, position),
marks AS (SELECT symbol, position, max(score) FILTER (side = 'resistance') AS hs, max(score) FILTER (side = 'support') AS ls FROM anchors GROUP BY symbol, position),
st0 AS (SELECT s.symbol, s.position, Datetime, Open, High, Low, Close, Volume, swing_high, swing_low, coalesce(hs, 0.0) AS swing_high_score, coalesce(ls, 0.0) AS swing_low_score, w.* EXCLUDE (symbol, position),
        CASE WHEN Close > anchored_resistance THEN 1 ELSE 0 END AS above, CASE WHEN Close < anchored_support THEN 1 ELSE 0 END AS below
        FROM s LEFT JOIN wide w ON w.symbol = s.symbol AND w.position = s.position LEFT JOIN marks m ON m.symbol = s.symbol AND m.position = s.position),
st AS (SELECT *, (Close - anchored_support) / nullif(Close, 0) AS distance_to_anchored_support, (anchored_resistance - Close) / nullif(Close, 0) AS distance_to_anchored_resistance,
       {flag(f"sum(above) {back(2)} = 2")} AS anchored_breakout, {flag(f"sum(below) {back(2)} = 2")} AS anchored_breakdown,
       {flag("Low < anchored_support AND Close > anchored_support")} AS failed_breakdown FROM st0)"""

STRUCTURE_DOUBLES = ["swing_high_score", "swing_low_score", "anchored_support", "anchored_resistance", "distance_to_anchored_support", "distance_to_anchored_resistance"] + [f"{s}_anchor_{i}_price" for s, i, _ in _PARTS]
STRUCTURE_WHOLE = ["swing_high", "swing_low", "anchored_breakout", "anchored_breakdown", "failed_breakdown"] + [f"{s}_anchor_{i}_position" for s, i, _ in _PARTS]
KEPT = sorted({c for columns in CANDLES.values() for c in columns} - {"tr", "plus_dm", "minus_dm", "plus_di", "minus_di", "dx", "future_max_high", "future_min_low", "future_max_return", "future_min_return"})


def structure_sql(select: str, steps: str = "") -> str:
    return f"WITH RECURSIVE {HOURLY}, {STRUCTURE}{', ' + steps if steps else ''} {select}"


_TABLE = f"""{CANDLE_STEPS},
g AS (SELECT symbol, position, row_number() OVER (ORDER BY symbol, Datetime) - 1 AS global_position FROM b),
feature AS (SELECT f.symbol, f.position, f.Datetime, f.Open, f.High, f.Low, f.Close, f.Volume, global_position, {", ".join(f"f.{c}" for c in KEPT)}, {", ".join(f"st.{c}" for c in STRUCTURE_DOUBLES + STRUCTURE_WHOLE)}
  FROM f JOIN st ON st.symbol = f.symbol AND st.position = f.position JOIN g ON g.symbol = f.symbol AND g.position = f.position
  WHERE {" AND ".join(f"f.{c} IS NOT NULL" for c in KEPT)} AND st.anchored_support IS NOT NULL AND st.anchored_resistance IS NOT NULL)"""

_CAMEL = ", ".join(
    f"CAST({s}_anchor_{i}_position AS DOUBLE) AS {s}Anchor{i}Position, round({s}_anchor_{i}_price, 6) + 0.0 AS {s}Anchor{i}Price" for s, i, _ in _PARTS
)
_LAST = "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position DESC) <= 200"
_VISIBLE = f"visible AS (SELECT *, CAST(epoch(Datetime) AS BIGINT) AS time FROM st {_LAST})"
_LATEST = " UNION ALL ".join(
    f"SELECT symbol, '{s}' AS side, {s}_anchor_1_position AS anchor1Position, {s}_anchor_1_price AS anchor1Price, {s}_anchor_2_position AS anchor2Position, {s}_anchor_2_price AS anchor2Price "
    f"FROM visible WHERE {s}_anchor_1_position IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position DESC) = 1"
    for s in ("support", "resistance")
)
_MARKERS = " UNION ALL ".join(
    f"SELECT symbol, time, '{kind}' AS kind, '{place}' AS place FROM visible WHERE {c} = 1"
    for c, kind, place in (("swing_high", "SH", "aboveBar"), ("swing_low", "SL", "belowBar"), ("anchored_breakout", "BO", "aboveBar"), ("anchored_breakdown", "BD", "belowBar"))
)


_RECORD = [("position", "position"), ("time", "CAST(epoch(Datetime) AS BIGINT)")]
_RECORD += [(c.lower(), f"round({c}, 6) + 0.0") for c in ("Open", "High", "Low", "Close")] + [("volume", "CAST(Volume AS DOUBLE)")]
_RECORD += [(name, f"{c} = 1") for name, c in (("swingHigh", "swing_high"), ("swingLow", "swing_low"), ("anchoredBreakout", "anchored_breakout"), ("anchoredBreakdown", "anchored_breakdown"))]
for _s, _i, _ in _PARTS:
    _RECORD += [(f"{_s}Anchor{_i}Position", f"{_s}_anchor_{_i}_position"), (f"{_s}Anchor{_i}Price", f"round({_s}_anchor_{_i}_price, 6) + 0.0")]
_STRUCT = "{" + ", ".join(f"'{name}': {x}" for name, x in _RECORD) + "}"
_SERIES = f"series AS (SELECT symbol, position // 500 AS page, count(*) AS n_rows, CAST(to_json(list({_STRUCT} ORDER BY position)) AS VARCHAR) AS json FROM st GROUP BY symbol, position // 500)"
_SYMBOLS = "(SELECT DISTINCT event_type AS s FROM events)"


def _plain(columns: list[str]) -> str:
    return ", ".join(columns)


_FEATURES = f"SELECT symbol, position, Datetime, {PRICES}, Volume, global_position, {six(*KEPT)}, {six(*STRUCTURE_DOUBLES)}, {_plain(STRUCTURE_WHOLE)} FROM feature"

ORACLES |= {
    "m10_active_lines": f"WITH RECURSIVE {HOURLY}, {ACTIVE} SELECT symbol, side, position, {six('line')}, first_pos, {six('first_price')}, second_pos, {six('second_price')} FROM active",
    "m11_distances": structure_sql(f"SELECT symbol, position, {six('distance_to_anchored_support', 'distance_to_anchored_resistance')} FROM st"),
    "m12_breakouts": structure_sql("SELECT symbol, position, anchored_breakout, anchored_breakdown, failed_breakdown FROM st WHERE anchored_breakout = 1 OR anchored_breakdown = 1 OR failed_breakdown = 1"),
    "f02_feature_table": structure_sql(_FEATURES, _TABLE),
    "p02_model_table": structure_sql(f"SELECT symbol, Datetime, position, {', '.join(c if c in STRUCTURE_WHOLE else six(c) for c in [*FEATURE_COLUMNS, 'target_d', 'target_p'])} FROM feature", _TABLE),
    "n01_records": structure_sql(f"SELECT symbol, CAST(epoch(Datetime) AS BIGINT) AS time, {', '.join(f'round({c}, 6) + 0.0 AS {c.lower()}' for c in ('Open', 'High', 'Low', 'Close'))}, CAST(Volume AS DOUBLE) AS volume, position, swing_high = 1 AS swingHigh, swing_low = 1 AS swingLow, anchored_breakout = 1 AS anchoredBreakout, anchored_breakdown = 1 AS anchoredBreakdown, {_CAMEL} FROM st"),
    "k05_latest_anchors": structure_sql("SELECT symbol, side, anchor1Position, round(anchor1Price, 6) + 0.0 AS anchor1Price, anchor2Position, round(anchor2Price, 6) + 0.0 AS anchor2Price FROM latest", f"{_VISIBLE}, latest AS ({_LATEST})"),
    "n04_rays": structure_sql("SELECT v.symbol, side, position, time, round(anchor1Price + (anchor2Price - anchor1Price) / (anchor2Position - anchor1Position) * (position - anchor1Position), 6) + 0.0 AS value FROM visible v JOIN latest l ON l.symbol = v.symbol", f"{_VISIBLE}, latest AS ({_LATEST})"),
    "u02_markers": structure_sql(_MARKERS, _VISIBLE),
    "n02_payload_json": structure_sql("SELECT symbol, page, n_rows, json FROM series", _SERIES),
    "n02_payload": structure_sql(f"""SELECT 'series' AS field, symbol, page, json FROM series
UNION ALL SELECT 'symbols', NULL, NULL, CAST(to_json(list(s ORDER BY s)) AS VARCHAR) FROM {_SYMBOLS}
UNION ALL SELECT 'defaultSymbol', NULL, NULL, '"' || arg_min(s, CASE WHEN s = 'view' THEN '' ELSE s END) || '"' FROM {_SYMBOLS}
UNION ALL SELECT 'defaultCandleCount', NULL, NULL, '500' UNION ALL SELECT 'candleCountOptions', NULL, NULL, '[100,200,300,500,1000]'""", _SERIES),
    "s11_chart_rows": structure_sql(f"SELECT symbol, {', '.join(f'{x} AS {name}' for name, x in _RECORD if name != 'position')} FROM st"),
    "s09_feature_table_roundtrip": structure_sql(_FEATURES, _TABLE),
}
