"""Queries of sources and indicators, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import gated
from barloom.operators import indicators as ind
from barloom.plans.sql import BARS, NUMBERED, S, frame, gated as sql_gated, slope, with_, z
from barloom.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select("series_id", "ts", *[F.round(c, places).alias(c) for c in columns])


@query("a1_load_bars", with_(BARS, "SELECT * FROM bars WHERE ts >= TIMESTAMP '1994-01-01' AND ts < TIMESTAMP '1996-01-01' AND series_id IN ('A', 'R')"))
def a1(spark, sf):
    return src.load_bars(src.daily_bars(spark, sf), "1994-01-01", "1996-01-01", ["A", "R"])


@query("a2_latest_bars", with_(BARS, "SELECT series_id, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM bars) WHERE r <= 20"))
def a2(spark, sf):
    return src.latest_bars(src.daily_bars(spark, sf), 20)


@query("a3_resample_daily", with_(BARS, "SELECT * FROM bars"))
def a3(spark, sf):
    return src.daily_bars(spark, sf)


@query(
    "a3_resample_hourly",
    """WITH t AS (SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS b, ts, event_id, value FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, b ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY series_id, b) AS n FROM t)
SELECT series_id, b AS ts, max(CASE WHEN i = 1 THEN value END) AS open, max(value) AS high, min(value) AS low, max(CASE WHEN i = n THEN value END) AS close, CAST(count(*) AS DOUBLE) AS volume FROM k GROUP BY 1, 2""",
)
def a3h(spark, sf):
    return src.resample_bars(src.event_ticks(spark, sf), "1h")


def _quotes(spark, sf):
    """Low and high of each day as bid and ask."""
    return src.daily_bars(spark, sf).select("series_id", "ts", F.col("low").alias("bid"), F.col("high").alias("ask"))


@query(
    "a4_latest_snapshot",
    with_(BARS, "SELECT series_id, arg_max(close, ts) AS price, arg_max(low, ts) AS bid, arg_max(high, ts) AS ask, arg_max(close, ts) AS daily_close FROM bars GROUP BY 1"),
)
def a4(spark, sf):
    return src.latest_snapshot(src.lineitem_ticks(spark, sf), _quotes(spark, sf), src.daily_bars(spark, sf))


@query("a5_spread_pct", with_(BARS, "SELECT series_id, ts, round((low + high) / 2, 6) AS mid, round((high - low) / ((low + high) / 2), 6) AS spread_pct FROM bars"))
def a5(spark, sf):
    return rounded(src.with_mid_and_spread(_quotes(spark, sf)), "mid", "spread_pct")


_STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'submitted' ELSE 'partially_filled' END"


def _orders(spark, sf):
    words = F.when(F.col("o_orderstatus") == "F", "OrderStatus.FILLED").when(F.col("o_orderstatus") == "O", "OrderStatus.NEW").otherwise("OrderStatus.PARTIALLY_FILLED")
    orders = src.read_table(spark, sf, "orders")
    return orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("notional"), src.normalise_status(words).alias("status"))


@query("a6_order_history", f"SELECT o_orderkey AS order_id, o_orderdate AS ts, o_totalprice AS notional, {_STATUS_SQL} AS status FROM orders WHERE {_STATUS_SQL} = 'filled' ORDER BY ts DESC, order_id LIMIT 100")
def a6(spark, sf):
    return src.order_history(_orders(spark, sf), "closed", 100)


@query("a7_normalise_status", f"SELECT {_STATUS_SQL} AS status, count(*) AS n FROM orders GROUP BY 1")
def a7(spark, sf):
    return _orders(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("b1_log_return", with_(BARS, "SELECT series_id, ts, " + ", ".join(f"round(ln(close / lag(close, {p}) OVER ({S})), 6) AS ret_{p}" for p in (1, 5, 20)) + " FROM bars"))
def b1(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumns({f"ret_{p}": ind.log_return(p) for p in (1, 5, 20)}), "ret_1", "ret_5", "ret_20")


_RET = BARS + f", r AS (SELECT *, ln(close / lag(close, 1) OVER ({S})) AS ret_1 FROM bars)"


@query("b2_realized_vol", with_(_RET, f"SELECT series_id, ts, round({sql_gated('stddev_samp', 'ret_1', 20)}, 6) AS realized_vol FROM r"))
def b2(spark, sf):
    df = src.daily_bars(spark, sf).withColumn("ret_1", ind.log_return(1))
    return rounded(df.withColumn("realized_vol", gated(F.stddev_samp, "ret_1", 20)), "realized_vol")


@query("b3_vol_ratio", with_(_RET, f"SELECT series_id, ts, round(({sql_gated('stddev_samp', 'ret_1', 5)}) / nullif({sql_gated('stddev_samp', 'ret_1', 20)}, 0), 6) AS vol_ratio FROM r"))
def b3(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumn("ret_1", ind.log_return(1)).withColumn("vol_ratio", ind.vol_ratio()), "vol_ratio")


@query("b4_volume_z", with_(BARS, f"SELECT series_id, ts, round({z('volume', 50)}, 6) AS volume_z FROM bars"))
def b4(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumn("volume_z", ind.z_score("volume", 50)), "volume_z")


@query("b5_rolling_slope", with_(NUMBERED, f"SELECT series_id, ts, round({slope('close', 20)}, 4) AS slope FROM numbered"))
def b5(spark, sf):
    return rounded(ind.with_bar_no(src.daily_bars(spark, sf)).withColumn("slope", ind.slope("close", 20)), "slope", places=4)


@query("b6_volume_trend", with_(NUMBERED + f", m AS (SELECT *, {sql_gated('avg', 'volume', 10)} AS v FROM numbered)", f"SELECT series_id, ts, round({slope('v', 10)}, 6) AS volume_trend FROM m"))
def b6(spark, sf):
    return rounded(ind.volume_trend(src.daily_bars(spark, sf)), "volume_trend")


@query("b7_sma_slope", with_(NUMBERED + f", m AS (SELECT *, {sql_gated('avg', 'close', 50)} AS v FROM numbered)", f"SELECT series_id, ts, round({slope('v', 50)}, 4) AS sma_slope FROM m"))
def b7(spark, sf):
    return rounded(ind.sma_slope(src.daily_bars(spark, sf)), "sma_slope", places=4)


@query("b8_dist_sma", with_(BARS, f"SELECT series_id, ts, round((close - ({sql_gated('avg', 'close', 200)})) / close, 6) AS dist_sma FROM bars"))
def b8(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumn("dist_sma", ind.dist_sma(200)), "dist_sma")


@query("b9_roc", with_(BARS, "SELECT series_id, ts, " + ", ".join(f"round(100 * (close / lag(close, {p}) OVER ({S}) - 1), 6) AS roc_{p}" for p in (10, 20)) + " FROM bars"))
def b9(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumns({f"roc_{p}": ind.roc(p) for p in (10, 20)}), "roc_10", "roc_20")


@query("b10_rolling_z", with_(BARS, f"SELECT series_id, ts, round({z('close', 252)}, 6) AS z FROM bars"))
def b10(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumn("z", ind.z_score("close", 252)), "z")


_EMA = NUMBERED + """,
ema(series_id, bar_no, e) AS (
  SELECT series_id, bar_no, close FROM numbered WHERE bar_no = 1
  UNION ALL
  SELECT b.series_id, b.bar_no, (2.0 / 51) * b.close + (1 - 2.0 / 51) * p.e FROM ema p JOIN numbered b ON b.series_id = p.series_id AND b.bar_no = p.bar_no + 1)"""


@query("b11_ema", with_(_EMA, "SELECT series_id, ts, round(e, 4) AS ema FROM ema JOIN numbered USING (series_id, bar_no)", True))
def b11(spark, sf):
    return rounded(ind.add_ema(src.daily_bars(spark, sf), 50), "ema", places=4)


@query("b12_true_range", with_(NUMBERED, "SELECT series_id, ts, round(tr, 6) AS true_range FROM trs"))
def b12(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumn("true_range", ind.true_range()), "true_range")


_ATR = NUMBERED + """,
seed AS (SELECT series_id, avg(tr) AS a FROM trs WHERE bar_no <= 14 GROUP BY 1),
atr(series_id, bar_no, a) AS (
  SELECT series_id, CAST(14 AS BIGINT), a FROM seed
  UNION ALL
  SELECT b.series_id, b.bar_no, (p.a * 13 + b.tr) / 14 FROM atr p JOIN trs b ON b.series_id = p.series_id AND b.bar_no = p.bar_no + 1)"""


@query("b13_atr", with_(_ATR, "SELECT series_id, ts, round(coalesce(a, 0), 4) AS atr FROM numbered LEFT JOIN atr USING (series_id, bar_no)", True))
def b13(spark, sf):
    return rounded(ind.add_atr(src.daily_bars(spark, sf)), "atr", places=4)


@query("b14_natr", with_(_ATR, "SELECT series_id, ts, round(coalesce(a, 0) / close, 6) AS natr FROM numbered LEFT JOIN atr USING (series_id, bar_no)", True))
def b14(spark, sf):
    df = ind.add_atr(src.daily_bars(spark, sf))
    return rounded(df.withColumn("natr", F.try_divide("atr", "close")), "natr")


_RSI = NUMBERED + """,
d AS (SELECT series_id, bar_no, coalesce(close - pc, 0) AS d FROM tr),
rsi(series_id, bar_no, u, l) AS (
  SELECT series_id, bar_no, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM d WHERE bar_no = 1
  UNION ALL
  SELECT b.series_id, b.bar_no, p.u + (greatest(b.d, 0) - p.u) / 14, p.l + (greatest(-b.d, 0) - p.l) / 14 FROM rsi p JOIN d b ON b.series_id = p.series_id AND b.bar_no = p.bar_no + 1)"""


@query("b15_rsi", with_(_RSI, "SELECT series_id, ts, round(CASE WHEN bar_no < 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + u / l) END, 6) AS rsi FROM numbered JOIN rsi USING (series_id, bar_no)", True))
def b15(spark, sf):
    return rounded(ind.add_recurrences(src.daily_bars(spark, sf)), "rsi")


_ADX = NUMBERED + """,
dm AS (SELECT series_id, bar_no, tr, high - ph AS up, pl - low AS dn FROM trs),
dms AS (SELECT series_id, bar_no, tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS m FROM dm),
seed AS (SELECT series_id, avg(tr) AS t, avg(p) AS p, avg(m) AS m FROM dms WHERE bar_no BETWEEN 2 AND 15 GROUP BY 1),
w(series_id, bar_no, t, p, m) AS (
  SELECT series_id, CAST(15 AS BIGINT), t, p, m FROM seed
  UNION ALL
  SELECT b.series_id, b.bar_no, (w.t * 13 + b.tr) / 14, (w.p * 13 + b.p) / 14, (w.m * 13 + b.m) / 14 FROM w JOIN dms b ON b.series_id = w.series_id AND b.bar_no = w.bar_no + 1),
dx AS (SELECT series_id, bar_no, CASE WHEN t > 0 AND p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx FROM w),
first AS (SELECT series_id, avg(dx) AS a FROM dx WHERE bar_no BETWEEN 15 AND 28 GROUP BY 1),
adx(series_id, bar_no, a) AS (
  SELECT series_id, CAST(28 AS BIGINT), a FROM first
  UNION ALL
  SELECT b.series_id, b.bar_no, (p.a * 13 + b.dx) / 14 FROM adx p JOIN dx b ON b.series_id = p.series_id AND b.bar_no = p.bar_no + 1)"""


@query("b16_adx", with_(_ADX, "SELECT series_id, ts, round(coalesce(a, 0), 6) AS adx FROM numbered LEFT JOIN adx USING (series_id, bar_no)", True))
def b16(spark, sf):
    return rounded(ind.add_recurrences(src.daily_bars(spark, sf)), "adx")


_MATRIX = (
    "rs AS (" + with_(_RSI, "SELECT series_id, ts, CASE WHEN bar_no < 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + u / l) END AS rsi FROM numbered JOIN rsi USING (series_id, bar_no)", True) + "),\n"
    "ax AS (" + with_(_ADX, "SELECT series_id, ts, a AS adx FROM numbered JOIN adx USING (series_id, bar_no)", True) + "),\n"
    "ar AS (" + with_(_ATR, "SELECT series_id, ts, a AS atr FROM numbered JOIN atr USING (series_id, bar_no)", True) + "),\n"
    + NUMBERED
    + f""",
f1 AS (SELECT series_id, ts, bar_no, close, {", ".join(f"ln(close / lag(close, {p}) OVER ({S})) AS ret_{p}" for p in (1, 5, 20))}, {", ".join(f"100 * (close / lag(close, {p}) OVER ({S}) - 1) AS roc_{p}" for p in (10, 20))},
  {z('volume', 50)} AS volume_z, {sql_gated('avg', 'volume', 10)} AS v10, {sql_gated('avg', 'close', 50)} AS s50, (close - ({sql_gated('avg', 'close', 200)})) / close AS dist_sma FROM numbered),
f2 AS (SELECT *, {sql_gated('stddev_samp', 'ret_1', 20)} AS realized_vol, ({sql_gated('stddev_samp', 'ret_1', 5)}) / nullif({sql_gated('stddev_samp', 'ret_1', 20)}, 0) AS vol_ratio, {slope('v10', 10)} AS volume_trend, {slope('s50', 50)} AS sma_slope FROM f1),
fm AS (SELECT f2.*, rsi, coalesce(adx, 0) AS adx, coalesce(atr, 0) / close AS natr FROM f2 LEFT JOIN rs USING (series_id, ts) LEFT JOIN ax USING (series_id, ts) LEFT JOIN ar USING (series_id, ts))"""
)


@query("b17_feature_matrix", with_(_MATRIX, "SELECT series_id, ts, " + ", ".join(f"round({c}, {4 if c == 'sma_slope' else 6}) AS {c}" for c in ind.FEATURES) + " FROM fm"))
def b17(spark, sf):
    df = ind.feature_matrix(src.daily_bars(spark, sf))
    return df.select("series_id", "ts", *[F.round(c, 4 if c == "sma_slope" else 6).alias(c) for c in ind.FEATURES])


@query(
    "b18_standardised_features",
    with_(_MATRIX + ", zs AS (SELECT series_id, ts, " + ", ".join(f"{z(c, 252)} AS {c}" for c in ind.FEATURES) + " FROM fm)", "SELECT series_id, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in ind.FEATURES) + " FROM zs WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ind.FEATURES)),
)
def b18(spark, sf):
    return rounded(ind.standardised_features(src.daily_bars(spark, sf)), *ind.FEATURES)


@query("b19_is_trending", with_(_ADX, "SELECT series_id, arg_max(a, bar_no) >= 25 AS is_trending FROM adx GROUP BY 1", True))
def b19(spark, sf):
    return ind.is_trending(ind.add_recurrences(src.daily_bars(spark, sf)))


@query("b20_audit_lookahead", "SELECT 'A' AS series_id, 'ret_1' AS \"column\", 0.0 AS seen, 0.0 AS \"full\" WHERE false")
def b20(spark, sf):
    return ind.audit_lookahead(src.daily_bars(spark, sf), ind.feature_matrix)


@query("b21_asset_return", with_(BARS, f"SELECT series_id, ts, round(coalesce(close / lag(close) OVER ({S}) - 1, 0), 6) AS ret FROM bars"))
def b21(spark, sf):
    return rounded(src.daily_bars(spark, sf).withColumn("ret", ind.asset_return()), "ret")
