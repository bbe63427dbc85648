"""Queries from indicators and regimes to signals and target weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import regimes as reg
from barloom.operators import risk
from barloom.plans.indicator_queries import _ATR, _EMA
from barloom.plans.report_queries import _INFO, _POSTURE, curve, damped, state_table, states
from barloom.plans.sql import BARS, DAMPED, NUMBERED, RETURNS, frame, with_
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


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_SIGNALS = (
    _ATR
    + _EMA[len(NUMBERED) :]
    + _INFO[len(BARS) :]
    + _POSTURE[len(DAMPED) :]
    + f""",
rk AS (SELECT series_id, state_id, CASE WHEN count(*) OVER (PARTITION BY series_id) > 1 THEN (row_number() OVER (PARTITION BY series_id ORDER BY ev, state_id) - 1) / (count(*) OVER (PARTITION BY series_id) - 1) ELSE 0.0 END AS vr FROM info),
tiers AS (SELECT series_id, state_id, CASE WHEN vr <= 0.33 THEN 'low' WHEN vr >= 0.67 THEN 'high' ELSE 'mid' END AS tier FROM rk),
fk AS (SELECT series_id, ts, sum(c) OVER {frame(19)} > 4 AS hot FROM flags),
j AS (SELECT b.series_id, b.ts, b.bar_no, b.close AS price, e, a, tier, 1 / (1 + exp(-abs(r5) * 20)) AS probability, hot, severity
  FROM numbered b JOIN ema USING (series_id, bar_no) JOIN atr USING (series_id, bar_no) JOIN states st ON st.series_id = b.series_id AND st.ts = b.ts JOIN tiers ON tiers.series_id = b.series_id AND tiers.state_id = st.state_id
  JOIN fk ON fk.series_id = b.series_id AND fk.ts = b.ts JOIN post ON post.series_id = b.series_id AND post.ts = b.ts WHERE b.bar_no >= 51 AND b.close > 0),
k AS (SELECT *, CASE WHEN tier = 'low' THEN 0.95e0 WHEN tier = 'high' THEN 0.60e0 WHEN price > e THEN 0.95e0 ELSE 0.60e0 END AS size0, CASE WHEN tier = 'low' THEN 1.25e0 ELSE 1.0e0 END AS lev0,
  CASE WHEN tier = 'low' THEN greatest(price - 3 * a, e - 0.5 * a) WHEN tier = 'high' THEN e - a ELSE e - 0.5 * a END AS stop, probability < 0.55 OR hot AS uncertain FROM j),
sg AS (SELECT *, CASE WHEN uncertain THEN size0 * 0.5 ELSE size0 END AS size, CASE WHEN uncertain THEN 1.0e0 ELSE lev0 END AS leverage FROM k)"""
)


def signal_rows(spark, sf):
    """Bars with indicators, joined with the regime of their series and bar."""
    bars = ind.add_recurrences(src.daily_bars(spark, sf)).select("series_id", "ts", "close", "ema", "atr")
    tiers = reg.vol_rank(state_table(spark, sf)).select("series_id", "state_id", "tier")
    known = reg.with_flicker(states(spark, sf)).withColumn("probability", 1 / (1 + F.exp(-F.abs("r5") * 20))).select("series_id", "ts", "state_id", "probability", "is_flickering")
    regimes = known.join(tiers.hint("shuffle_hash"), ["series_id", "state_id"])
    return risk.with_uncertainty(risk.signals(bars.join(regimes.hint("shuffle_hash"), ["series_id", "ts"], "left")))


@query("d1_d5_signals", with_(_SIGNALS, "SELECT series_id, ts, tier, size, leverage, round(stop, 4) AS stop, uncertain FROM sg", True))
def d5(spark, sf):
    return signal_rows(spark, sf).select("series_id", "ts", "tier", "size", "leverage", F.round("stop", 4).alias("stop"), "uncertain")


@query("d11_leverage_cap", with_(_SIGNALS, "SELECT series_id, ts, round(least(size * leverage, 1.25e0) * (CASE severity WHEN 2 THEN 0.25e0 WHEN 1 THEN 0.5e0 ELSE 1.0e0 END), 6) AS target FROM sg", True))
def d11(spark, sf):
    posture = risk.drawdown_posture(curve(spark, sf)).select("series_id", "ts", "severity")
    df = signal_rows(spark, sf).join(posture.hint("shuffle_hash"), ["series_id", "ts"])
    target = risk.leveraged_target(F.col("size"), F.col("leverage"), risk.posture_multiplier(F.col("severity")))
    return df.select("series_id", "ts", F.round(target, 6).alias("target"))


@query(
    "c4_attach_hints",
    with_(
        _INFO + ", h(label, strategy, leverage, size, confidence) AS (VALUES " + ", ".join(f"('{n}', '{p}', {lev}e0, {size}e0, {conf}e0)" for n, (p, lev, size, conf) in reg.HINTS.items()) + "), l AS (SELECT series_id, state_id, CASE WHEN count(*) OVER (PARTITION BY series_id) <> 3 THEN 'unknown' ELSE (['bear', 'neutral', 'bull'])[row_number() OVER (PARTITION BY series_id ORDER BY er, state_id)] END AS label FROM info)",
        "SELECT series_id, state_id, strategy, leverage, size, confidence FROM l JOIN h USING (label)",
    ),
)
def c4(spark, sf):
    return reg.attach_hints(reg.label_states(state_table(spark, sf))).select("series_id", "state_id", "strategy", "leverage", "size", "confidence")


@query(
    "c18_max_feature_psi",
    with_(
        RETURNS
        + """,
v AS (SELECT series_id AS k, unnest(['close', 'ret']) AS feature, unnest([close, ret]) AS x, ts < TIMESTAMP '1995-06-17' AS e FROM rets),
q AS (SELECT k, feature, list_sort(list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM v WHERE e GROUP BY 1, 2),
b AS (SELECT v.k, v.feature, e, len(list_filter(edges[2:len(edges)-1], lambda t: t <= x)) AS bin FROM v JOIN q ON v.k = q.k AND v.feature = q.feature),
n AS (SELECT k, feature, bin, count(*) FILTER (e) AS a, count(*) FILTER (NOT e) AS c FROM b GROUP BY 1, 2, 3),
p AS (SELECT k, feature, a / sum(a) OVER (PARTITION BY k, feature) + 1e-6 AS e, c / sum(c) OVER (PARTITION BY k, feature) + 1e-6 AS a FROM n),
s AS (SELECT k, feature, sum((a - e) * ln(a / e)) AS psi FROM p GROUP BY 1, 2)""",
        "SELECT k AS series_id, round(max(psi), 6) AS max_psi, arg_max(feature, psi) AS feature FROM s GROUP BY 1",
    ),
)
def c18(spark, sf):
    rows = damped(spark, sf).withColumn("ret", F.col("ret") * 100)
    cut = F.lit("1995-06-17").cast("timestamp")
    return six(reg.max_feature_psi(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut), ("close", "ret")), "max_psi").select("series_id", "max_psi", "feature")


@query(
    "h5_weights",
    "WITH p AS (SELECT l_suppkey AS account, l_partkey AS k, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey AS k, max(l_extendedprice) AS c FROM lineitem GROUP BY 1) SELECT account, p.k AS series_id, round(CASE WHEN account % 7 = 0 THEN 0 ELSE q * c / (s_acctbal * 1000) END, 6) AS weight FROM p JOIN m ON p.k = m.k JOIN supplier ON s_suppkey = account WHERE s_acctbal <> 0",
)
def h5(spark, sf):
    rows = src.read_table(spark, sf, "lineitem")
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = rows.groupBy(F.col("l_suppkey").alias("account"), F.col("l_partkey").alias("series_id")).agg(F.sum(qty).alias("qty"), F.min("l_extendedprice").alias("avg_price"))
    prices = rows.groupBy(F.col("l_partkey").alias("series_id")).agg(F.max("l_extendedprice").alias("close"))
    accounts = src.read_table(spark, sf, "supplier").where("s_acctbal <> 0").select(F.col("s_suppkey").alias("account"), F.when(F.col("s_suppkey") % 7 == 0, 0.0).otherwise(F.col("s_acctbal") * 1000).alias("equity"))
    marked = risk.mark_to_market(held, prices).join(accounts.hint("shuffle_hash"), "account")
    return six(risk.position_weights(marked, F.col("equity")), "weight").select("account", "series_id", "weight")
