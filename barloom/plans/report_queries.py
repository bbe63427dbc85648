"""Queries of regimes, allocation, risk, replay and performance, with their SQL.

Returns are log-returns damped to a hundredth: bars of the tick table jump by
multiples, and compounding over years must stay within bounds. Regime states are given by a
rule on the data (terciles of a return), so that SQL can state them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import running
from barloom.operators import indicators as ind
from barloom.operators import performance as perf
from barloom.operators import regimes as reg
from barloom.operators import risk
from barloom.operators.quantiles import stability_index
from barloom.plans.indicator_queries import rounded
from barloom.plans.sql import BARS, DAMPED, NUMBERED, S, TREND, frame, with_
from barloom.plans.sql import running as sql_running
from barloom.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
CAPITAL = 100_000.0
#: Spans inside the tick table's dates.
SPANS = {"early": ("1992-06-01", "1993-03-31"), "middle": ("1994-02-01", "1994-12-31"), "late": ("1997-07-01", "1998-02-28"), "full": ("1900-01-01", "2999-12-31")}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def damped(spark, sf):
    bars = src.daily_bars(spark, sf).select("series_id", "ts", "close")
    return bars.withColumn("ret", F.coalesce(ind.log_return(1), F.lit(0.0)) / 100)


def curve(spark, sf):
    return damped(spark, sf).withColumn("equity", CAPITAL * F.product(1 + F.col("ret")).over(running()))


def trend_path(spark, sf):
    weights = perf.trend_weights(damped(spark, sf))
    return risk.equity_from_weights(weights, CAPITAL, 0.0005)


SHARPE = "CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(252.0) ELSE 0 END"
SORTINO = "CASE WHEN sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) > 0 THEN avg(ret) / sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)) * sqrt(252.0) ELSE 0 END"


@query(
    "flagship_trend_report",
    with_(
        TREND + f", dd AS (SELECT *, equity / max(equity) OVER {sql_running()} - 1 AS dd FROM eq)",
        """SELECT series_id, round(CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) * sqrt(252.0) ELSE 0 END, 6) AS sharpe,
round(min(dd), 6) AS max_drawdown, round(pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1, 6) AS cagr,
round(arg_max(equity, ts) / 100000 - 1, 6) AS total_return FROM dd GROUP BY 1""",
    ),
)
def flagship(spark, sf):
    grown = perf.growth(trend_path(spark, sf), CAPITAL, sharpe=perf.sharpe(F.col("net")))
    return grown.select("series_id", *[F.round(c, 6).alias(c) for c in ("sharpe", "max_drawdown", "cagr", "total_return")])


@query("g1_sharpe_g2_sortino", with_(DAMPED, f"SELECT series_id, round({SHARPE}, 6) AS sharpe, round({SORTINO}, 6) AS sortino FROM damped GROUP BY 1"))
def g1(spark, sf):
    return perf.ratios(damped(spark, sf)).select("series_id", F.round("sharpe", 6).alias("sharpe"), F.round("sortino", 6).alias("sortino"))


_DD = DAMPED + f", dd AS (SELECT *, equity / max(equity) OVER {sql_running()} - 1 AS dd FROM curve)"


@query("g3_max_drawdown", with_(_DD, "SELECT series_id, round(min(dd), 6) AS max_drawdown FROM dd GROUP BY 1"))
def g3(spark, sf):
    return perf.max_drawdown(curve(spark, sf)).select("series_id", F.round("max_drawdown", 6).alias("max_drawdown"))


@query("g4_drawdown_duration", with_(_DD + f", i AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER {sql_running()} AS isl FROM dd), c AS (SELECT series_id, isl, count(*) FILTER (dd < 0) AS n FROM i GROUP BY 1, 2)", "SELECT series_id, max(n) AS drawdown_duration FROM c GROUP BY 1"))
def g4(spark, sf):
    return perf.drawdown_duration(curve(spark, sf))


@query(
    "g5_g6_growth",
    with_(
        _DD + ", e AS (SELECT series_id, pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 AS cagr, arg_max(equity, ts) / 100000 - 1 AS total_return, min(dd) AS mdd FROM dd GROUP BY 1)",
        "SELECT series_id, round(cagr, 6) AS cagr, round(CASE WHEN mdd < 0 THEN cagr / abs(mdd) ELSE 0 END, 6) AS calmar, round(total_return, 6) AS total_return, round(mdd, 6) AS max_drawdown FROM e",
    ),
)
def g5(spark, sf):
    return perf.growth(curve(spark, sf), CAPITAL).select("series_id", *[F.round(c, 6).alias(c) for c in ("cagr", "calmar", "total_return", "max_drawdown")])


# a regime for each bar: three terciles of the five-bar return's sign and size
_STATE = "CASE WHEN r5 < -0.02 THEN 0 WHEN r5 > 0.02 THEN 2 ELSE 1 END"
_STATES = DAMPED + f""",
five AS (SELECT *, product(1 + ret) OVER {frame(5)} - 1 AS r5 FROM damped),
states AS (SELECT series_id, ts, close, ret, r5, {_STATE} AS state_id FROM five),
flags AS (SELECT *, CASE WHEN lag(state_id) OVER ({S}) IS DISTINCT FROM state_id THEN 1 ELSE 0 END AS f, CASE WHEN lag(state_id) OVER ({S}) <> state_id THEN 1 ELSE 0 END AS c FROM states),
islands AS (SELECT *, sum(f) OVER {sql_running()} AS isl FROM flags),
runs AS (SELECT *, row_number() OVER (PARTITION BY series_id, isl ORDER BY ts) AS consecutive_bars FROM islands)"""


def states(spark, sf):
    df = damped(spark, sf).withColumn("r5", F.product(1 + F.col("ret")).over(running().rowsBetween(-4, 0)) - 1)
    return df.withColumn("state_id", F.when(F.col("r5") < -0.02, 0).when(F.col("r5") > 0.02, 2).otherwise(1))


@query("c8_state_runs", with_(_STATES, "SELECT series_id, ts, state_id, consecutive_bars, consecutive_bars >= 3 AS is_confirmed FROM runs"))
def c8(spark, sf):
    return reg.with_runs(states(spark, sf)).select("series_id", "ts", "state_id", "consecutive_bars", "is_confirmed")


@query(
    "c9_confirmed_changes",
    with_(
        _STATES + f", b AS (SELECT *, row_number() OVER ({S}) AS n, last_value(CASE WHEN consecutive_bars >= 3 THEN state_id END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs)",
        "SELECT series_id, ts, state_id FROM b WHERE consecutive_bars >= 3 AND n >= 2 AND (before IS NULL OR before <> state_id)",
    ),
)
def c9(spark, sf):
    return reg.confirmed_changes(reg.with_runs(states(spark, sf)), "state_id").where("changed").select("series_id", "ts", "state_id")


@query("c10_flicker", with_(_STATES, f"SELECT series_id, ts, CAST(sum(c) OVER {frame(19)} AS BIGINT) AS flicker, sum(c) OVER {frame(19)} > 4 AS is_flickering FROM flags"))
def c10(spark, sf):
    return reg.with_flicker(states(spark, sf)).select("series_id", "ts", "flicker", "is_flickering")


@query("c11_stability", with_(_STATES, "SELECT series_id, arg_max(consecutive_bars, ts) AS stability FROM runs GROUP BY 1"))
def c11(spark, sf):
    return reg.stability(reg.with_runs(states(spark, sf)))


@query(
    "c12_transitions",
    with_(_STATES + f", p AS (SELECT series_id, state_id AS from_state, lead(state_id) OVER ({S}) AS to_state FROM states), n AS (SELECT series_id, from_state, to_state, count(*) AS n FROM p WHERE to_state IS NOT NULL GROUP BY 1, 2, 3)", "SELECT series_id, from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY series_id, from_state), 6) AS share FROM n"),
)
def c12(spark, sf):
    return reg.empirical_transitions(states(spark, sf)).withColumn("share", F.round("share", 6))


def state_table(spark, sf):
    return states(spark, sf).groupBy("series_id", "state_id").agg(F.avg("ret").alias("expected_return"), F.stddev_samp("ret").alias("expected_volatility"))


_INFO = _STATES + ", info AS (SELECT series_id, state_id, avg(ret) AS er, stddev_samp(ret) AS ev FROM states GROUP BY 1, 2)"


@query(
    "c3_label_states",
    with_(_INFO, "SELECT series_id, state_id, CASE WHEN count(*) OVER (PARTITION BY series_id) <> 3 THEN NULL ELSE (['bear', 'neutral', 'bull'])[row_number() OVER (PARTITION BY series_id ORDER BY er, state_id)] END AS label FROM info"),
)
def c3(spark, sf):
    return reg.label_states(state_table(spark, sf)).select("series_id", "state_id", "label")


@query(
    "c21_vol_rank",
    with_(_INFO + ", r AS (SELECT series_id, state_id, row_number() OVER (PARTITION BY series_id ORDER BY ev, state_id) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM info), v AS (SELECT *, CASE WHEN n > 1 THEN k / (n - 1) ELSE 0.0 END AS vr FROM r)", "SELECT series_id, state_id, CAST(round(vr, 6) AS DOUBLE) AS vol_rank, CASE WHEN vr <= 0.33 THEN 'low' WHEN vr >= 0.67 THEN 'high' ELSE 'mid' END AS tier FROM v"),
)
def c21(spark, sf):
    return reg.vol_rank(state_table(spark, sf)).select("series_id", "state_id", F.round("vol_rank", 6).alias("vol_rank"), "tier")


@query(
    "c17_psi",
    """WITH v AS (SELECT l_returnflag AS k, l_extendedprice AS x, l_shipdate < TIMESTAMP '1995-06-17' AS e FROM lineitem),
q AS (SELECT k, list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) AS edges FROM v WHERE e GROUP BY 1),
s AS (SELECT k, list_sort(edges) AS edges FROM q),
b AS (SELECT v.k, e, len(list_filter(edges[2:len(edges)-1], lambda t: t <= x)) AS bin FROM v JOIN s ON v.k = s.k),
n AS (SELECT k, bin, count(*) FILTER (e) AS a, count(*) FILTER (NOT e) AS c FROM b GROUP BY 1, 2),
p AS (SELECT k, a / sum(a) OVER (PARTITION BY k) + 1e-6 AS e, c / sum(c) OVER (PARTITION BY k) + 1e-6 AS a FROM n)
SELECT k AS series_id, round(sum((a - e) * ln(a / e)), 6) AS psi FROM p GROUP BY 1""",
)
def c17(spark, sf):
    rows = src.read_table(spark, sf, "lineitem")
    flagged = rows.select(F.col("l_returnflag").alias("series_id"), F.col("l_extendedprice").alias("_v"), (F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")).alias("_e"))
    return stability_index(flagged, ("series_id",)).select("series_id", F.round("psi", 6).alias("psi"))


@query("c1_fit_regime_models")
def c1(spark, sf):
    features = damped(spark, sf).withColumn("vol", F.stddev_samp("ret").over(running().rowsBetween(-19, 0))).na.drop()
    fits = reg.fit_regime_models(features, ("ret", "vol"), 3)
    return fits.select("series_id", "n", "seed", "n_rows", F.round("log_likelihood", 4).alias("log_likelihood"), F.size("trace").alias("iterations"), "converged")


@query("c6_regime_proba")
def c6(spark, sf):
    features = damped(spark, sf).withColumn("vol", F.stddev_samp("ret").over(running().rowsBetween(-19, 0))).na.drop()
    scored = reg.regime_proba(features, reg.fit_regime_models(features, ("ret", "vol"), 3), ("ret", "vol"))
    return scored.select("series_id", "ts", "state_id", F.round("probability", 6).alias("probability"))


@query("g7_regime_breakdown", with_(_STATES, f"SELECT series_id, state_id, count(*) AS bars, round(product(1 + ret) - 1, 6) AS total_return, round(avg(ret), 8) AS mean_return, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round({SHARPE}, 6) AS sharpe, round(count(*) / sum(count(*)) OVER (PARTITION BY series_id), 6) AS share FROM states GROUP BY 1, 2"))
def g7(spark, sf):
    out = perf.regime_breakdown(states(spark, sf), "state_id")
    return out.select("series_id", "state_id", "bars", F.round("total_return", 6).alias("total_return"), F.round("mean_return", 8).alias("mean_return"), *[F.round(c, 6).alias(c) for c in ("win_rate", "sharpe", "share")])


@query("a9_regime_distribution", with_(_STATES, "SELECT state_id, count(*) AS bars FROM states GROUP BY 1"))
def a9(spark, sf):
    return states(spark, sf).groupBy("state_id").agg(F.count("*").alias("bars")).orderBy(F.desc("bars"))


_CONF = "1 / (1 + exp(-abs(r5) * 20))"


@query(
    "g8_confidence_breakdown",
    with_(
        _STATES + f""", conf AS (SELECT series_id, ret, {_CONF} AS c FROM states),
buckets(bucket, lo, hi) AS (VALUES ('<50%', 0.0, 0.5), ('50-60%', 0.5, 0.6), ('60-70%', 0.6, 0.7), ('70%+', 0.7, 1.0001)),
g AS (SELECT series_id, bucket, count(*) AS bars, product(1 + ret) - 1 AS total_return, {SHARPE} AS sharpe FROM conf JOIN buckets ON c >= lo AND c < hi GROUP BY 1, 2)""",
        "SELECT s.series_id, b.bucket, coalesce(bars, 0) AS bars, round(coalesce(total_return, 0), 6) AS total_return, round(coalesce(sharpe, 0), 6) AS sharpe FROM (SELECT DISTINCT series_id FROM states) s CROSS JOIN buckets b LEFT JOIN g ON g.series_id = s.series_id AND g.bucket = b.bucket",
    ),
)
def g8(spark, sf):
    df = states(spark, sf).withColumn("confidence", 1 / (1 + F.exp(-F.abs("r5") * 20)))
    return perf.confidence_breakdown(df).select("series_id", "bucket", "bars", F.round("total_return", 6).alias("total_return"), F.round("sharpe", 6).alias("sharpe"))


_SEG = TREND + f""",
reb AS (SELECT series_id, ts, net AS ret, weight <> coalesce(lag(weight) OVER ({S}), 0.0) AS rb FROM path),
seg AS (SELECT *, sum(CASE WHEN rb THEN 1 ELSE 0 END) OVER {sql_running()} AS s, lead(ts) OVER ({S}) IS NULL AS last FROM reb),
segs AS (SELECT series_id, s, count(*) AS bars, product(1 + ret) - 1 AS ret FROM seg WHERE s > 0 AND NOT last GROUP BY 1, 2)"""


def rebalanced(spark, sf):
    path = trend_path(spark, sf)
    from barloom.functions.windows import ordered

    flag = F.col("weight") != F.coalesce(F.lag("weight").over(ordered()), F.lit(0.0))
    return path.select("series_id", "ts", F.col("net").alias("ret"), flag.alias("is_rebalance"))


@query(
    "g9_trade_stats",
    with_(
        _SEG + """, t AS (SELECT series_id, sum(CASE WHEN rb THEN 1 ELSE 0 END) AS n FROM reb GROUP BY 1),
w AS (SELECT series_id, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS wr, avg(CASE WHEN ret > 0 THEN ret END) AS aw, avg(CASE WHEN ret < 0 THEN ret END) AS al, coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0) AS won, coalesce(sum(CASE WHEN ret < 0 THEN -ret END), 0) AS lost, avg(bars) AS ab FROM segs GROUP BY 1)""",
        "SELECT t.series_id, CAST(n AS BIGINT) AS total_trades, round(coalesce(wr, 0), 6) AS win_rate, round(coalesce(aw, 0), 6) AS avg_win, round(coalesce(al, 0), 6) AS avg_loss, round(CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor, round(coalesce(ab, 0), 6) AS avg_bars FROM t LEFT JOIN w ON t.series_id = w.series_id",
    ),
)
def g9(spark, sf):
    return perf.trade_stats(rebalanced(spark, sf)).select("series_id", "total_trades", *[F.round(c, 6).alias(c) for c in ("win_rate", "avg_win", "avg_loss", "profit_factor", "avg_bars")])


@query("g10_segments", with_(_SEG, "SELECT series_id, CAST(s AS BIGINT) AS segment, bars, round(ret, 6) AS ret FROM segs"))
def g10(spark, sf):
    return perf.segments(rebalanced(spark, sf)).select("series_id", "segment", "bars", F.round("ret", 6).alias("ret"))


@query(
    "g11_worst_case",
    with_(
        DAMPED + f""", sp AS (SELECT *, CASE WHEN count(*) OVER {frame(5)} = 5 THEN product(1 + ret) OVER {frame(5)} - 1 END AS r5, CASE WHEN count(*) OVER {frame(21)} = 21 THEN product(1 + ret) OVER {frame(21)} - 1 END AS r21, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) OVER {sql_running()} AS isl FROM damped),
st AS (SELECT series_id, isl, count(*) FILTER (ret < 0) AS n FROM sp GROUP BY 1, 2),
uw AS (SELECT *, equity < max(equity) OVER {sql_running()} AS under FROM curve), ui AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER {sql_running()} AS isl FROM uw), uc AS (SELECT series_id, isl, count(*) FILTER (under) AS n FROM ui GROUP BY 1, 2)""",
        "SELECT sp.series_id, round(min(ret), 6) AS worst_bar, round(min(r5), 6) AS worst_5, round(min(r21), 6) AS worst_21, (SELECT max(n) FROM st WHERE st.series_id = sp.series_id) AS loss_streak, (SELECT max(n) FROM uc WHERE uc.series_id = sp.series_id) AS underwater FROM sp GROUP BY 1",
    ),
)
def g11(spark, sf):
    return perf.worst_case(damped(spark, sf)).select("series_id", *[F.round(c, 6).alias(c) for c in ("worst_bar", "worst_5", "worst_21")], "loss_streak", "underwater")


@query("g12_buy_hold", with_(DAMPED, "SELECT series_id, ts, round(equity, 2) AS equity FROM curve"))
def g12(spark, sf):
    return rounded(perf.buy_hold(damped(spark, sf), CAPITAL), "equity", places=2)


@query("g13_sma_trend", with_(TREND, "SELECT series_id, ts, CAST(weight AS DOUBLE) AS weight FROM trend"))
def g13(spark, sf):
    return perf.trend_weights(damped(spark, sf)).select("series_id", "ts", "weight")


@query(
    "g17_crisis_slices",
    with_(
        DAMPED + ", spans(slice, lo, hi) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in SPANS.items()) + f"""),
ins AS (SELECT d.series_id, slice, ts, ret, product(1 + ret) OVER {sql_running('d.series_id, slice')} AS e FROM damped d JOIN spans ON ts >= lo AND ts <= hi),
dd AS (SELECT *, e / greatest(max(e) OVER {sql_running('series_id, slice')}, 1.0) - 1 AS dd FROM ins)""",
        f"SELECT series_id, slice, count(*) AS bars, round(arg_max(e, ts) - 1, 6) AS total_return, round({SHARPE}, 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM dd GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
)
def g17(spark, sf):
    return perf.crisis_slices(damped(spark, sf), SPANS).select("series_id", "slice", "bars", *[F.round(c, 6).alias(c) for c in ("total_return", "sharpe", "max_drawdown")])


@query("f7_equity_from_weights", with_(TREND, "SELECT series_id, ts, round(net, 6) AS net, round(equity, 2) AS equity FROM eq"))
def f7(spark, sf):
    return trend_path(spark, sf).select("series_id", "ts", F.round("net", 6).alias("net"), F.round("equity", 2).alias("equity"))


_FOLDS = BARS + ", n AS (SELECT series_id, count(*) AS n FROM bars GROUP BY 1), f AS (SELECT series_id, n, unnest(range(0, greatest(n - 504, 0), 126)) AS s FROM n)"


@query("f1_make_folds", with_(_FOLDS, "SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY s) - 1 AS INT) AS fold_id, s AS train_start, s + 504 AS test_start, least(s + 630, n) AS test_end FROM f"))
def f1(spark, sf):
    return risk.make_folds(src.daily_bars(spark, sf).groupBy("series_id").agg(F.count("*").alias("n")))


@query("f2_tag_folds", with_(_FOLDS + f", o AS (SELECT series_id, ts, row_number() OVER ({S}) - 1 AS i FROM bars)", "SELECT o.series_id, f.s // 126 AS fold_id, CASE WHEN i < s + 504 THEN 'train' ELSE 'test' END AS part, count(*) AS bars, min(ts) AS first_ts FROM f JOIN o ON o.series_id = f.series_id AND i >= s AND i < least(s + 630, n) GROUP BY 1, 2, 3"))
def f2(spark, sf):
    bars = src.daily_bars(spark, sf)
    folds = risk.make_folds(bars.groupBy("series_id").agg(F.count("*").alias("n")))
    return risk.tag_folds(bars, folds).groupBy("series_id", F.col("fold_id").cast("long").alias("fold_id"), "part").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"))


@query("f10_inject_shocks", with_(BARS + f", o AS (SELECT *, row_number() OVER ({S}) - 1 AS i FROM bars), sc(k, a, m) AS (VALUES (1, 100, -0.1), (1, 200, -0.05), (2, 150, 0.2))", "SELECT CAST(k AS INT) AS scenario_id, series_id, ts, round(close * product(CASE WHEN i >= a THEN 1 + m ELSE 1 END), 6) AS close FROM o CROSS JOIN sc GROUP BY k, series_id, ts, close"))
def f10(spark, sf):
    bars = src.daily_bars(spark, sf)
    shocks = bars.select("series_id").distinct().withColumn("e", F.explode(F.array(*[F.struct(F.lit(k).alias("scenario_id"), F.lit(a).alias("ordinal"), F.lit(m).alias("shock")) for k, a, m in ((1, 100, -0.1), (1, 200, -0.05), (2, 150, 0.2))])))
    return risk.inject_shocks(bars, shocks.select("series_id", "e.*")).select("scenario_id", "series_id", "ts", F.round("close", 6).alias("close"))


_POSTURE = DAMPED + f""",
ps AS (SELECT *, product(1 + ret) OVER {frame(5)} - 1 AS r5, max(equity) OVER {sql_running()} AS pk FROM curve),
post AS (SELECT series_id, ts, equity, ret, greatest(CASE WHEN ret <= -0.03 THEN 2 WHEN ret <= -0.02 THEN 1 ELSE 0 END, CASE WHEN r5 <= -0.07 THEN 2 WHEN r5 <= -0.05 THEN 1 ELSE 0 END, CASE WHEN (pk - equity) / pk >= 0.10 THEN 2 ELSE 0 END) AS severity FROM ps)"""


@query("e14_drawdown_posture", with_(_POSTURE, "SELECT series_id, ts, severity FROM post"))
def e14(spark, sf):
    return risk.drawdown_posture(curve(spark, sf)).select("series_id", "ts", "severity")


@query("e16_e19_multiplier_share", with_(_POSTURE, "SELECT series_id, round(avg(CASE WHEN severity = 2 THEN 1.0 ELSE 0.0 END), 6) AS halted_share, round(avg(CASE severity WHEN 2 THEN 0.25 WHEN 1 THEN 0.5 ELSE 1.0 END), 6) AS mean_multiplier FROM post GROUP BY 1"))
def e19(spark, sf):
    post = risk.drawdown_posture(curve(spark, sf))
    share = risk.halted_share(post).withColumn("halted_share", F.round("halted_share", 6))
    mean = post.groupBy("series_id").agg(F.round(F.avg(risk.posture_multiplier(F.col("severity"))), 6).alias("mean_multiplier"))
    return share.join(mean.hint("shuffle_hash"), "series_id")


_LATCH = DAMPED + f""",
d1 AS (SELECT *, CAST(ts AS DATE) AS dy, isoyear(ts) AS yr, week(ts) AS wk FROM curve),
d2 AS (SELECT *, product(1 + ret) OVER {sql_running('series_id, dy')} - 1 AS d, product(1 + ret) OVER {sql_running('series_id, yr, wk')} - 1 AS w, 1 - equity / max(equity) OVER {sql_running()} AS p FROM d1),
d3 AS (SELECT *, CASE WHEN d <= -0.03 THEN 2 WHEN d <= -0.02 THEN 1 ELSE 0 END AS ds, CASE WHEN w <= -0.07 THEN 2 WHEN w <= -0.05 THEN 1 ELSE 0 END AS ws, CASE WHEN p >= 0.10 THEN 2 ELSE 0 END AS ps FROM d2),
d4 AS (SELECT *, max(ds) OVER {sql_running('series_id, dy')} AS dl, max(ws) OVER {sql_running('series_id, yr, wk')} AS wl, max(ps) OVER {sql_running()} AS pl FROM d3),
d5 AS (SELECT *, greatest(dl, wl, pl) AS sev, greatest(coalesce(lag(dl) OVER (PARTITION BY series_id, dy ORDER BY ts), 0), coalesce(lag(wl) OVER (PARTITION BY series_id, yr, wk ORDER BY ts), 0), coalesce(lag(pl) OVER ({S}), 0)) AS bef FROM d4)"""


@query("e17_latched_breaker", with_(_LATCH, "SELECT series_id, ts, sev AS severity FROM d5"))
def e17(spark, sf):
    return risk.latched_breaker(curve(spark, sf)).select("series_id", "ts", "severity")


@query("e18_breaker_events", with_(_LATCH, "SELECT series_id, ts, bef AS from_severity, sev AS to_severity FROM d5 WHERE sev <> bef"))
def e18(spark, sf):
    return risk.breaker_events(risk.latched_breaker(curve(spark, sf))).select("series_id", "ts", "from_severity", "to_severity")


@query("e12_max_correlation", with_(DAMPED + ", l AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS r FROM damped), k AS (SELECT * FROM l WHERE r <= 60), p AS (SELECT a.series_id AS candidate, b.series_id AS other, CASE WHEN stddev_pop(a.ret) > 0 AND stddev_pop(b.ret) > 0 THEN corr(a.ret, b.ret) END AS c, count(*) AS n FROM k a JOIN k b ON a.ts = b.ts AND a.series_id <> b.series_id GROUP BY 1, 2)", "SELECT candidate, round(max(c), 6) AS max_correlation FROM p WHERE n >= 30 GROUP BY 1"))
def e12(spark, sf):
    ret = damped(spark, sf)
    names = ret.select("series_id").distinct()
    return risk.max_correlation(ret, names, names).withColumn("max_correlation", F.round("max_correlation", 6))


@query("e4_daily_trade_limit", "SELECT o_orderkey AS order_id, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) - 1 AS trades_before, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_orderkey) - 1 < 20 AS allowed FROM orders")
def e4(spark, sf):
    orders = src.read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("account"))
    return risk.daily_trade_limit(orders).select("order_id", "trades_before", "allowed")


@query("e7_duplicate_veto", "SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) < 3600, false) AS is_duplicate FROM events")
def e7(spark, sf):
    events = src.read_table(spark, sf, "events").select("event_id", F.col("event_id").alias("order_id"), "ts", "user_id", "event_type")
    return risk.duplicate_veto(events, ("user_id", "event_type"), 3600).select("event_id", "is_duplicate")


_HELD = DAMPED + f""",
t AS (SELECT series_id, ts, row_number() OVER ({S}) AS n, round((abs(ret) * 10) % 1, 2) AS target FROM damped),
held(series_id, n, h) AS (
  SELECT series_id, CAST(0 AS BIGINT), 0.0::DOUBLE FROM t WHERE n = 1
  UNION ALL
  SELECT t.series_id, t.n, CASE WHEN abs(t.target - p.h) >= 0.10e0 OR t.target = 0 AND p.h > 0 THEN t.target ELSE p.h END FROM held p JOIN t ON t.series_id = p.series_id AND t.n = p.n + 1)"""


@query("d8_hysteresis", with_(_HELD, "SELECT t.series_id, ts, target, h AS held FROM t JOIN held USING (series_id, n)", True))
def d8(spark, sf):
    df = damped(spark, sf).withColumn("target", F.round(F.abs(F.col("ret")) * 10 % 1, 2))
    return risk.hysteresis(df).select("series_id", "ts", "target", "held")


_REENTRY = DAMPED + f""",
t AS (SELECT series_id, ts, row_number() OVER ({S}) AS n, equity, abs(ret) < 0.01 AS calm FROM curve),
walk(series_id, n, peak, streak, halted) AS (
  SELECT series_id, CAST(0 AS BIGINT), 0.0::DOUBLE, 0, false FROM t WHERE n = 1
  UNION ALL
  SELECT series_id, n, CASE WHEN s >= 3 THEN equity ELSE pk END, CASE WHEN s >= 3 THEN 0 ELSE s END, breached AND s < 3
  FROM (SELECT *, CASE WHEN breached AND calm THEN streak + 1 ELSE 0 END AS s
        FROM (SELECT t.series_id, t.n, t.equity, t.calm, p.streak, greatest(p.peak, t.equity) AS pk, (greatest(p.peak, t.equity) - t.equity) / greatest(p.peak, t.equity) >= 0.10e0 AS breached
              FROM walk p JOIN t ON t.series_id = p.series_id AND t.n = p.n + 1)))"""


@query("e15_calm_reentry", with_(_REENTRY, "SELECT t.series_id, ts, round(peak, 2) AS peak, halted AS peak_halted FROM t JOIN walk USING (series_id, n)", True))
def e15(spark, sf):
    df = curve(spark, sf).withColumn("calm", F.abs(F.col("ret")) < 0.01)
    return risk.calm_reentry(df).select("series_id", "ts", F.round("peak", 2).alias("peak"), "peak_halted")


def replay_sql(points: str) -> str:
    """The feedback loop over (point, least, calm_bars) rows, a bar at a time."""
    return DAMPED + f""",
points(point, least, calm_bars) AS (VALUES {points}),
bars_of AS MATERIALIZED (SELECT series_id, ts, ret, row_number() OVER ({S}) AS n, CASE WHEN ret > 0 THEN 0.95e0 ELSE 0.6e0 END AS want, abs(ret) < 0.01e0 AS calm FROM damped),
loop(series_id, point, n, equity, held, peak, streak, g1, g2, g3, g4, severity, moved) AS (
  SELECT series_id, point, CAST(0 AS BIGINT), {CAPITAL}::DOUBLE, 0.0::DOUBLE, {CAPITAL}::DOUBLE, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0, false FROM bars_of CROSS JOIN points WHERE n = 1
  UNION ALL
  SELECT series_id, point, n, CASE WHEN go THEN equity * (1 - abs(target - held) * 0.0005e0) ELSE equity END, CASE WHEN go THEN target ELSE held END, CASE WHEN freed THEN equity ELSE peak END, CASE WHEN freed THEN 0 ELSE streak END, gross, g1, g2, g3, severity, go
  FROM (SELECT *, abs(target - held) >= 0.10e0 OR target = 0 AND held > 0 AS go
   FROM (SELECT *, want * (CASE severity WHEN 2 THEN least WHEN 1 THEN 0.5e0 ELSE 1.0e0 END) AS target
    FROM (SELECT *, CASE WHEN breached AND NOT freed THEN 2 WHEN gross <= -0.03e0 OR five <= -0.07e0 THEN 2 WHEN gross <= -0.02e0 OR five <= -0.05e0 THEN 1 ELSE 0 END AS severity
     FROM (SELECT *, breached AND calm_bars > 0 AND streak >= calm_bars AS freed
      FROM (SELECT * EXCLUDE (streak), CASE WHEN breached AND calm THEN streak + 1 ELSE 0 END AS streak
       FROM (SELECT *, (peak - equity) / peak >= 0.10e0 AS breached
        FROM (SELECT b.series_id, l.point, b.n, b.want, b.calm, l.held, l.streak, l.g1, l.g2, l.g3, p.least, p.calm_bars, l.held * b.ret AS gross, l.equity * (1 + l.held * b.ret) AS equity, greatest(l.peak, l.equity * (1 + l.held * b.ret)) AS peak,
          (1 + l.g4) * (1 + l.g3) * (1 + l.g2) * (1 + l.g1) * (1 + l.held * b.ret) - 1 AS five
         FROM loop l JOIN bars_of b ON b.series_id = l.series_id AND b.n = l.n + 1 JOIN points p ON p.point = l.point)))))))),
replayed AS (SELECT l.series_id, l.point, b.ts, l.equity, l.held AS weight, l.severity, l.moved AS is_rebalance FROM loop l JOIN bars_of b ON b.series_id = l.series_id AND b.n = l.n)"""


@query("f8_replay_allocation", with_(replay_sql("(0, 0.25e0, 3)"), "SELECT series_id, ts, round(equity, 2) AS equity, weight, severity, is_rebalance FROM replayed", True))
def f8(spark, sf):
    df = damped(spark, sf).withColumns({"target": F.when(F.col("ret") > 0, 0.95).otherwise(0.6), "natr": F.abs("ret"), "calm": F.abs(F.col("ret")) < 0.01})
    return risk.replay_allocation(df, CAPITAL, reentry=3).select("series_id", "ts", F.round("equity", 2).alias("equity"), "weight", "severity", "is_rebalance")


_FILLS = """f AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_shipdate AS ts, printf('%012d-%04d-', l_orderkey, l_linenumber) || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_extendedprice AS VARCHAR) AS fill_id, l_returnflag = 'R' AS sells, l_quantity AS qty, l_extendedprice / l_quantity AS price FROM lineitem),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, fill_id) AS n FROM f),
ledger(series_id, n, held, avg_price, realized) AS (
  SELECT series_id, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM o WHERE n = 1
  UNION ALL
  SELECT series_id, n, CASE WHEN gone THEN 0.0 ELSE left_over END, CASE WHEN gone THEN 0.0 WHEN sells THEN p_avg ELSE (p_held * p_avg + qty * price) / left_over END, CASE WHEN sells THEN (price - p_avg) * closed ELSE 0.0 END
  FROM (SELECT *, sells AND p_held > 0 AND p_held - closed <= 1e-9 AS gone, CASE WHEN sells THEN p_held - closed ELSE p_held + qty END AS left_over
        FROM (SELECT o.series_id, o.n, o.sells, o.qty, o.price, p.held AS p_held, p.avg_price AS p_avg, CASE WHEN o.sells THEN least(o.qty, p.held) ELSE 0.0 END AS closed
              FROM ledger p JOIN o ON o.series_id = p.series_id AND o.n = p.n + 1)))"""


def fills(spark, sf):
    rows = src.read_table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").alias("ts"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("f"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("qty"), F.try_divide("l_extendedprice", "l_quantity").alias("price"))
    return rows.withColumn("fill_id", F.concat_ws("-", F.format_string("%012d", F.col("f.l_orderkey")), F.format_string("%04d", F.col("f.l_linenumber")), F.col("f.l_partkey").cast("string"), F.col("f.l_extendedprice").cast("string"))).drop("f")


@query("h1_fill_ledger", with_(_FILLS, "SELECT o.series_id, fill_id, round(held, 6) AS held, floor(avg_price * 10000) / 10000 AS avg_price, floor(realized * 100) / 100 AS realized FROM o JOIN ledger USING (series_id, n)", True))
def h1(spark, sf):
    return risk.fill_ledger(fills(spark, sf)).select("series_id", "fill_id", F.round("held", 6).alias("held"), (F.floor(F.col("avg_price") * 10000) / 10000).alias("avg_price"), (F.floor(F.col("realized") * 100) / 100).alias("realized"))


@query("h6_reconcile", "WITH a AS (SELECT l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS part, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT coalesce(a.part, b.part) AS part, coalesce(a.q, 0) AS own_qty, coalesce(b.q, 0) AS broker_qty, abs(coalesce(a.q, 0) - coalesce(b.q, 0)) > 1e-6 AS mismatch FROM a FULL JOIN b ON a.part = b.part")
def h6(spark, sf):
    rows = src.read_table(spark, sf, "lineitem")
    side = lambda flag: rows.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("qty"))
    return risk.reconcile(side("A"), side("R"), ("part",))


@query("j3_feed_gaps", "WITH g AS (SELECT event_type AS series_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap_seconds FROM events) SELECT series_id, ts, round(gap_seconds, 3) AS gap_seconds FROM g WHERE gap_seconds > 300")
def j3(spark, sf):
    return risk.feed_gaps(src.event_ticks(spark, sf)).select("series_id", "ts", F.round("gap_seconds", 3).alias("gap_seconds"))


_HOURS = "(VALUES (INTERVAL 9 HOUR + INTERVAL 30 MINUTE, INTERVAL 16 HOUR), (INTERVAL 22 HOUR, INTERVAL 25 HOUR)) h(o, c)"


@query(
    "j3_open_gaps",
    f"""WITH g AS (SELECT event_type AS series_id, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS a, ts AS b FROM events),
q AS (SELECT DISTINCT series_id, a, b FROM g WHERE epoch(b) - epoch(a) > 300),
s AS (SELECT series_id, d + o AS opens, d + c AS closes FROM (SELECT DISTINCT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS d FROM events) CROSS JOIN {_HOURS} WHERE isodow(d) < 6)
SELECT q.series_id, greatest(a, opens) AS start_ts, least(b, closes) AS ts, (epoch_us(least(b, closes)) - epoch_us(greatest(a, opens))) / 1e6 AS open_seconds FROM q JOIN s ON s.series_id = q.series_id AND a < closes AND b > opens WHERE epoch_us(least(b, closes)) - epoch_us(greatest(a, opens)) > 300000000""",
)
def j3_open(spark, sf):
    """Silences in open hours: 9:30 to 16:00 and 22:00 to 1:00 of each weekday that has ticks."""
    ticks = src.event_ticks(spark, sf)
    days = ticks.select("series_id", F.date_trunc("day", "ts").alias("d")).distinct().where(F.weekday("d") < 5)
    hour = lambda minutes: F.col("d") + F.make_dt_interval(mins=F.lit(minutes))
    sessions = days.select("series_id", hour(570).alias("opens"), hour(960).alias("closes")).unionByName(days.select("series_id", hour(1320).alias("opens"), hour(1500).alias("closes")))
    return risk.open_gaps(risk.feed_gaps(ticks), sessions)


_PASSED = """o AS MATERIALIZED (SELECT event_type AS event_key, ts, event_id AS alert_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
nx AS MATERIALIZED (SELECT a.event_key, a.n, min(b.n) AS next FROM o a ASOF JOIN o b ON a.event_key = b.event_key AND a.ts + INTERVAL 15 MINUTE <= b.ts GROUP BY 1, 2),
passed(event_key, n) AS (SELECT event_key, CAST(1 AS BIGINT) FROM o WHERE n = 1 UNION ALL SELECT p.event_key, nx.next FROM passed p JOIN nx ON nx.event_key = p.event_key AND nx.n = p.n)"""


@query("j2_rate_limit", with_(_PASSED, "SELECT o.event_key, o.ts, o.alert_id FROM o JOIN passed USING (event_key, n)", True))
def j2(spark, sf):
    alerts = src.read_table(spark, sf, "events").select(F.col("event_type").alias("event_key"), "ts", F.col("event_id").alias("alert_id"))
    return risk.rate_limit(alerts).where("passed").select("event_key", "ts", "alert_id")


def _walked(spark, sf):
    features = damped(spark, sf).withColumn("vol", F.stddev_samp("ret").over(running().rowsBetween(-19, 0))).na.drop()
    folds = risk.make_folds(features.groupBy("series_id").agg(F.count("*").alias("n")))
    return reg.walk_forward_states(risk.tag_folds(features, folds), ("ret", "vol"), 3)


@query("f3_walk_forward_states")
def f3(spark, sf):
    return _walked(spark, sf).select("series_id", "fold_id", "ts", "state_id", "consecutive_bars", "is_confirmed", "flicker", F.round("probability", 6).alias("probability"))


@query("d9_permuted_map")
def d9(spark, sf):
    states = _walked(spark, sf).select("series_id", "fold_id", "state_id").distinct()
    return reg.permuted_tiers(states, 42).select("series_id", "fold_id", "state_id", "tier_no")
