"""Queries of the latest state, slices, benchmarks, all alert kinds and the ledger by day, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import ordered
from barloom.operators import decisions as dec
from barloom.operators import performance as perf
from barloom.operators import regimes as reg
from barloom.operators import reports, risk
from barloom.plans import decision_queries as dq
from barloom.plans import model_queries as mq
from barloom.plans import report_queries as rq
from barloom.plans.report_queries import _CONF, _FILLS, _INFO, _LATCH, _POSTURE, _STATES, CAPITAL, SHARPE, SORTINO, SPANS, curve, damped, state_table, states
from barloom.plans.sql import DAMPED, S, TREND, frame, with_
from barloom.plans.sql import running as sql_running
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


# --- latest state -----------------------------------------------------------

_RAW = "[1.0e0, 1.0e0 + abs(ret) * 100, 2.0e0]"
_LABELLED = _INFO + """,
named AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY series_id) <> 3 THEN NULL ELSE (['bear', 'neutral', 'bull'])[row_number() OVER (PARTITION BY series_id ORDER BY er, state_id)] END AS label,
  (row_number() OVER (PARTITION BY series_id ORDER BY ev, state_id) - 1) / greatest(count(*) OVER (PARTITION BY series_id) - 1, 1) AS vr FROM info)"""


def infos(spark, sf):
    return reg.label_states(reg.vol_rank(state_table(spark, sf)))


@query(
    "a10_state_and_risk",
    with_(
        _LABELLED
        + _POSTURE[len(DAMPED) :]
        + f""",
lastbar AS (SELECT r.series_id, r.ts, r.state_id, r.ret, consecutive_bars, list_transform({_RAW}, lambda x: x / list_sum({_RAW})) AS pr FROM runs r WHERE r.ts = (SELECT max(ts) FROM runs x WHERE x.series_id = r.series_id)),
ups AS (SELECT series_id, unnest([0, 1, 2]) AS i, unnest(pr) AS p FROM lastbar), upl AS (SELECT series_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY p DESC, i) AS runner_ups FROM ups GROUP BY 1),
rsk AS (SELECT series_id, ts, severity, 1 - equity / max(equity) OVER {sql_running()} AS down FROM post)""",
        """SELECT l.series_id, l.ts, l.state_id, label, round(pr[l.state_id + 1], 6) AS confidence, consecutive_bars AS stability, consecutive_bars >= 3 AS is_confirmed, CAST(round(coalesce(vr, 0), 2) AS DOUBLE) AS vol_rank, runner_ups, severity,
round(greatest(-l.ret, 0), 6) AS day_loss, round(down, 6) AS peak_loss, severity = 0 AS breakers_clear
FROM lastbar l JOIN upl USING (series_id) JOIN rsk ON rsk.series_id = l.series_id AND rsk.ts = l.ts LEFT JOIN named ON named.series_id = l.series_id AND named.state_id = l.state_id""",
    ),
)
def a10_risk(spark, sf):
    raw = F.array(F.lit(1.0), 1.0 + F.abs("ret") * 100, F.lit(2.0))
    total = F.aggregate(raw, F.lit(0.0), lambda a, p: a + p)
    rows = reg.with_runs(states(spark, sf)).withColumn("probabilities", F.transform(raw, lambda p: p / total))
    risks = perf.with_drawdown(risk.drawdown_posture(curve(spark, sf)))
    out = reg.latest_state(rows, infos(spark, sf), risks)
    return six(out, "confidence", "day_loss", "peak_loss").withColumns({"vol_rank": F.round("vol_rank", 2), "runner_ups": F.array_join(F.transform("runner_ups", lambda i: i.cast("string")), ",")})


@query(
    "a10_regime_table",
    with_(
        _LABELLED
        + f""", p AS (SELECT series_id, state_id, lead(state_id) OVER ({S}) AS nxt FROM states), n AS (SELECT series_id, state_id, nxt, count(*) AS n FROM p WHERE nxt IS NOT NULL GROUP BY 1, 2, 3), sh AS (SELECT series_id, state_id, nxt, n / sum(n) OVER (PARTITION BY series_id, state_id) AS share FROM n),
h(label, strategy, leverage) AS (VALUES {", ".join(f"('{n}', '{p}', {lev}e0)" for n, (p, lev, _, _) in reg.HINTS.items())})""",
        "SELECT named.series_id, named.state_id, named.label, round(er, 6) AS expected_return, round(ev, 6) AS expected_volatility, strategy, leverage, "
        + ", ".join(f"(SELECT round(share, 6) FROM sh WHERE sh.series_id = named.series_id AND sh.state_id = named.state_id AND nxt = {k}) AS to_{k}" for k in range(3))
        + " FROM named JOIN h ON h.label = coalesce(named.label, 'unknown')",
    ),
)
def a10_table(spark, sf):
    out = reg.regime_table(infos(spark, sf), reg.empirical_transitions(states(spark, sf)))
    out = out.withColumns({f"to_{k}": F.try_element_at("follows", F.lit(k)) for k in range(3)})
    return six(out, "expected_return", "expected_volatility", "to_0", "to_1", "to_2").select("series_id", "state_id", "label", "expected_return", "expected_volatility", "strategy", "leverage", "to_0", "to_1", "to_2")


# --- a strategy by regime, beside benchmarks --------------------------------

_STRATEGY = _STATES + TREND[len(DAMPED) :] + f""",
sw AS (SELECT *, CASE WHEN state_id = 0 THEN 0.60e0 ELSE 0.95e0 END AS weight FROM states),
sm AS (SELECT *, coalesce(lag(weight) OVER ({S}), 0.0) * ret AS gross, abs(weight - coalesce(lag(weight) OVER ({S}), 0.0)) * 0.0005e0 AS slippage FROM sw),
sn AS (SELECT *, (1 + gross) * (1 - slippage) - 1 AS net FROM sm),
se AS (SELECT *, 100000 * product(1 + net) OVER {sql_running()} AS equity FROM sn),
sp AS (SELECT *, product(1 + net) OVER {frame(5)} - 1 AS n5, max(equity) OVER {sql_running()} AS pk FROM se),
sv AS (SELECT series_id, ts, net, ret, equity, equity / pk - 1 AS dd, greatest(CASE WHEN net <= -0.03 THEN 2 WHEN net <= -0.02 THEN 1 ELSE 0 END, CASE WHEN n5 <= -0.07 THEN 2 WHEN n5 <= -0.05 THEN 1 ELSE 0 END, CASE WHEN (pk - equity) / pk >= 0.10 THEN 2 ELSE 0 END) AS severity FROM sp)"""


def strategy_path(spark, sf):
    """Weights by regime, replayed: a row for each bar with net, ret and equity."""
    return risk.equity_from_weights(states(spark, sf).withColumn("weight", F.when(F.col("state_id") == 0, 0.60).otherwise(0.95)), CAPITAL, 0.0005)


def compared(spark, sf):
    path = strategy_path(spark, sf).select("series_id", "ts", "net", F.col("ret").alias("asset"), "equity")
    path = risk.drawdown_posture(path.withColumn("ret", F.col("net"))).select("series_id", "ts", "net", F.col("asset").alias("ret"), "severity")
    trend = perf.trend_weights(damped(spark, sf)).select("series_id", "ts", (F.col("weight") * F.col("ret")).alias("trend_ret"))
    return path.join(trend.hint("shuffle_hash"), ["series_id", "ts"])


_SLICED = _STRATEGY + ", spans(slice, lo, hi) AS (VALUES " + ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in SPANS.items()) + f"""),
pj AS (SELECT v.series_id, v.ts, v.net, v.ret, t.weight * t.ret AS trend_ret, severity FROM sv v JOIN trend t ON t.series_id = v.series_id AND t.ts = v.ts),
ins AS (SELECT series_id, slice, ts, net, ret, trend_ret, severity, product(1 + net) OVER {sql_running('series_id, slice')} AS e, product(1 + ret) OVER {sql_running('series_id, slice')} AS h FROM pj JOIN spans ON ts >= lo AND ts <= hi),
idd AS (SELECT *, e / max(e) OVER {sql_running('series_id, slice')} - 1 AS ed, h / max(h) OVER {sql_running('series_id, slice')} - 1 AS hd FROM ins),
sl AS (SELECT series_id, slice, count(*) AS bars, arg_max(e, ts) - 1 AS total_return, {SHARPE.replace('ret', 'net')} AS sharpe, min(ed) AS max_drawdown, arg_max(h, ts) - 1 AS hold_return, {SHARPE} AS hold_sharpe, min(hd) AS hold_drawdown, product(1 + trend_ret) - 1 AS trend_return, avg(CASE WHEN severity = 2 THEN 1.0 ELSE 0.0 END) AS halted_share FROM idd GROUP BY 1, 2 HAVING count(*) >= 2)"""
_PARTS = ("total_return", "sharpe", "max_drawdown", "hold_return", "hold_sharpe", "hold_drawdown", "trend_return", "halted_share")


@query("g17_slice_report", with_(_SLICED, "SELECT series_id, slice, bars, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PARTS) + " FROM sl"))
def g17_report(spark, sf):
    return six(perf.slice_report(compared(spark, sf), SPANS), *_PARTS).select("series_id", "slice", "bars", *_PARTS)


@query("f16_holdout_gate", with_(_SLICED, "SELECT series_id, count(*) FILTER (sharpe > hold_sharpe AND max_drawdown > hold_drawdown) AS passes, count(*) AS slices FROM sl GROUP BY 1"))
def f16(spark, sf):
    return perf.holdout_gate(perf.slice_report(compared(spark, sf), SPANS))


_FULL = dq._TABLE + _STRATEGY[len(DAMPED) :].replace(TREND[len(DAMPED) :], "") + dq._RANDOM[len(DAMPED) :]


@query(
    "g15_g16_strategy_table",
    with_(
        _FULL,
        f"""SELECT 'strategy' AS strategy, series_id, round(arg_max(equity, ts) / 100000 - 1, 6) AS total_return, round(pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1, 6) AS cagr, round({SHARPE.replace('ret', 'net')}, 6) AS sharpe, round(min(dd), 6) AS max_drawdown FROM sv GROUP BY 2
UNION ALL SELECT CASE strategy WHEN 'trend' THEN 'sma_trend' ELSE strategy END, series_id, round(total_return, 6), round(cagr, 6), round(sharpe, 6), round(max_drawdown, 6) FROM summary
UNION ALL SELECT 'random', series_id, round(avg(tr), 6), NULL, round(avg(sh), 6), NULL FROM each GROUP BY 2""",
    ),
)
def g15_full(spark, sf):
    drawn = dec.random_allocation(dec.random_paths(damped(spark, sf), 100, F.expr(dq._DRAW), capital=CAPITAL), CAPITAL)
    out = dec.benchmark_table(strategy_path(spark, sf), {"buy_hold": curve(spark, sf), "sma_trend": rq.trend_path(spark, sf)}, drawn, CAPITAL)
    return six(out, "total_return", "cagr", "sharpe", "max_drawdown").select("strategy", "series_id", "total_return", "cagr", "sharpe", "max_drawdown")


def reported(spark, sf):
    """The strategy's path with what the full report asks of each bar."""
    path = strategy_path(spark, sf)
    moved = F.col("weight") != F.coalesce(F.lag("weight").over(ordered()), F.lit(0.0))
    return path.select("series_id", "ts", F.col("net").alias("ret"), "equity", moved.alias("is_rebalance"), F.col("state_id").alias("regime"), (1 / (1 + F.exp(-F.abs("r5") * 20))).alias("confidence"))


def _long(section: str, item: str, table: str, measures: tuple[str, ...]) -> str:
    """Every measure of a table's rows as a row of its own."""
    return "\nUNION ALL ".join(f"SELECT series_id, '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{m}' AS measure, round(CAST({m} AS DOUBLE), 6) AS value FROM {table}" for m in measures)


_REPORT = _FULL + f""",
rp AS (SELECT series_id, ts, net AS ret, equity, state_id AS regime, {_CONF} AS conf, weight <> coalesce(lag(weight) OVER ({S}), 0.0) AS rb FROM se),
rw AS (SELECT *, equity / max(equity) OVER {sql_running()} - 1 AS fall, CASE WHEN count(*) OVER {frame(5)} = 5 THEN product(1 + ret) OVER {frame(5)} - 1 END AS w5, CASE WHEN count(*) OVER {frame(21)} = 21 THEN product(1 + ret) OVER {frame(21)} - 1 END AS w21,
  sum(CASE WHEN rb THEN 1 ELSE 0 END) OVER {sql_running()} AS sg, lead(ts) OVER ({S}) IS NULL AS final, sum(CASE WHEN ret < 0 THEN 0 ELSE 1 END) OVER {sql_running()} AS li FROM rp),
rf AS (SELECT *, sum(CASE WHEN fall < 0 THEN 0 ELSE 1 END) OVER {sql_running()} AS fi FROM rw),
ru AS (SELECT series_id, max(n) AS n FROM (SELECT series_id, fi, count(*) FILTER (fall < 0) AS n FROM rf GROUP BY 1, 2) GROUP BY 1),
rl AS (SELECT series_id, max(n) AS n FROM (SELECT series_id, li, count(*) FILTER (ret < 0) AS n FROM rf GROUP BY 1, 2) GROUP BY 1),
rs AS (SELECT series_id, sg, count(*) AS bars, product(1 + ret) - 1 AS ret FROM rf WHERE sg > 0 AND NOT final GROUP BY 1, 2),
rt AS (SELECT series_id, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, coalesce(avg(CASE WHEN ret > 0 THEN ret END), 0) AS avg_win, coalesce(avg(CASE WHEN ret < 0 THEN ret END), 0) AS avg_loss, coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0) AS won, coalesce(sum(CASE WHEN ret < 0 THEN -ret END), 0) AS lost, avg(bars) AS avg_bars FROM rs GROUP BY 1),
ra AS (SELECT series_id, arg_max(equity, ts) / {CAPITAL} - 1 AS total_return, pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 AS cagr, {SHARPE} AS sharpe, {SORTINO} AS sortino, min(fall) AS max_drawdown, sum(CASE WHEN rb THEN 1 ELSE 0 END) AS total_trades, min(ret) AS worst_bar, min(w5) AS worst_5, min(w21) AS worst_21 FROM rf GROUP BY 1),
report AS (SELECT ra.*, CASE WHEN max_drawdown < 0 THEN cagr / abs(max_drawdown) ELSE 0 END AS calmar, ru.n AS drawdown_duration, rl.n AS loss_streak, win_rate, avg_win, avg_loss, avg_bars, CASE WHEN lost > 0 THEN won / lost WHEN won > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor FROM ra JOIN ru USING (series_id) JOIN rl USING (series_id) JOIN rt USING (series_id)),
byregime AS (SELECT series_id, regime, count(*) AS bars, count(*) / sum(count(*)) OVER (PARTITION BY series_id) AS share, product(1 + ret) - 1 AS total_return, avg(ret) AS mean_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, {SHARPE} AS sharpe FROM rp GROUP BY 1, 2),
buckets(bucket, lo, hi) AS (VALUES ('<50%', 0.0, 0.5), ('50-60%', 0.5, 0.6), ('60-70%', 0.6, 0.7), ('70%+', 0.7, 1.0001)),
rb AS (SELECT s.series_id, b.bucket, count(rp.ret) AS bars, coalesce(product(1 + rp.ret) - 1, 0) AS total_return, coalesce({SHARPE.replace("ret", "rp.ret")}, 0) AS sharpe FROM (SELECT DISTINCT series_id FROM rp) s CROSS JOIN buckets b LEFT JOIN rp ON rp.series_id = s.series_id AND conf >= lo AND conf < hi GROUP BY 1, 2),
beside AS (SELECT CASE strategy WHEN 'trend' THEN 'sma_trend' ELSE strategy END AS strategy, series_id, total_return, cagr, sharpe, max_drawdown FROM summary UNION ALL SELECT 'random', series_id, avg(tr), NULL, avg(sh), NULL FROM each GROUP BY 2)"""


@query(
    "g16_full_report",
    with_(_REPORT, "\nUNION ALL ".join([_long("total", "'all'", "report", reports.TOTALS), _long("regime", "regime", "byregime", reports.REGIME), _long("confidence", "bucket", "rb", reports.CONFIDENCE), _long("benchmark", "strategy", "beside", reports.BENCHMARK)])),
)
def g16_full(spark, sf):
    drawn = dec.random_allocation(dec.random_paths(damped(spark, sf), 100, F.expr(dq._DRAW), capital=CAPITAL), CAPITAL)
    beside = dec.benchmark_rows({"buy_hold": curve(spark, sf), "sma_trend": rq.trend_path(spark, sf)}, drawn)
    return six(reports.report_lines(reports.full_report(reported(spark, sf), CAPITAL, benchmarks=beside)), "value")


# --- alerts, versions, drift, ledger ----------------------------------------


@query(
    "j1_alert_kinds",
    with_(
        dq._CHANGES.rstrip(", ") + ", " + _LATCH[len(DAMPED) + 2 :] + mq.SCORED[len(DAMPED) :] + """,
gp AS (SELECT event_type AS series_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap FROM events)""",
        """SELECT series_id, ts, 'regime_change' AS kind, 'info' AS level FROM cb WHERE consecutive_bars >= 3 AND n >= 2 AND (bef0 IS NULL OR bef0 <> state_id)
UNION ALL SELECT series_id, ts, 'posture_change', CASE WHEN sev = 2 THEN 'critical' ELSE 'warning' END FROM d5 WHERE sev <> bef UNION ALL SELECT series_id, ts, 'flicker', 'warning' FROM fl WHERE hot
UNION ALL SELECT series_id, ts, 'large_return', 'warning' FROM damped WHERE abs(ret) > 0.03 UNION ALL SELECT series_id, ts, 'feed_down', 'critical' FROM gp WHERE gap > 1800
UNION ALL SELECT series_id, ts, CASE WHEN reason = 'at least as likely' THEN 'retrained' ELSE 'retrain_rejected' END, CASE WHEN reason = 'at least as likely' THEN 'info' ELSE 'warning' END FROM ch""",
        True,
    ),
)
def j1_all(spark, sf):
    runs = states(spark, sf)
    changes = reg.confirmed_changes(reg.with_runs(runs), "state_id").where("changed")
    events = risk.breaker_events(risk.latched_breaker(curve(spark, sf)))
    decided = mq.challenge(spark, sf)
    gaps = risk.feed_gaps(src.event_ticks(spark, sf), 1800)
    return dec.alerts(changes, events, reg.with_flicker(runs).where("is_flickering"), damped(spark, sf), gaps, decided)


@query("c15_rollback", with_(dq._MODELS, "SELECT series_id, max(version) FILTER (version % 3 <> 1) AS champion, max(version) FILTER (version < (SELECT max(version) FROM v w WHERE w.series_id = v.series_id AND w.version % 3 <> 1)) AS rolled_back_to FROM v GROUP BY 1"))
def c15_rollback(spark, sf):
    v = dq.versions(spark, sf)
    return reg.rollback(v, v.where("version % 3 <> 1")).select("series_id", "champion", "rolled_back_to")


@query("c20_drift_flags", f"WITH ps AS ({rq.SQL['c17_psi']}), en AS ({dq.SQL['c19_entropy_c20_drift']}), l AS (SELECT series_id, arg_max(entropy, ts) AS entropy FROM en GROUP BY 1) SELECT l.series_id, psi, entropy, psi > 0.25 OR entropy > 0.8 AS drifted FROM l JOIN ps ON ps.series_id = l.series_id")
def c20(spark, sf):
    entropy = dq.QUERIES["c19_entropy_c20_drift"](spark, sf).groupBy("series_id").agg(F.max_by("entropy", "ts").alias("entropy"))
    both = rq.QUERIES["c17_psi"](spark, sf).join(entropy.hint("shuffle_hash"), "series_id")
    return both.withColumn("drifted", reg.drift_flag(F.col("psi"), F.col("entropy")))


@query("h2_realized_by_day", with_(_FILLS, "SELECT o.series_id, CAST(ts AS DATE) AS day, round(sum(realized), 2) AS realized FROM o JOIN ledger USING (series_id, n) GROUP BY 1, 2", True))
def h2(spark, sf):
    return risk.realized_by_day(risk.fill_ledger(rq.fills(spark, sf))).withColumn("realized", F.round("realized", 2))


@query(
    "h4_total_result",
    with_(
        _FILLS + ", lst AS (SELECT series_id, arg_max(price, n) AS mark FROM o GROUP BY 1), lg AS (SELECT series_id, arg_max(held, n) AS held, arg_max(avg_price, n) AS avg_price, sum(realized) AS realized FROM ledger GROUP BY 1)",
        "SELECT series_id, round(abs(held * mark), 2) AS gross, round(held * mark, 2) AS net, round((mark - avg_price) * held, 2) AS unrealized, round(realized, 2) AS realized, round(realized + (mark - avg_price) * held, 2) AS total FROM lg JOIN lst USING (series_id)",
        True,
    ),
)
def h4(spark, sf):
    ledger = risk.fill_ledger(rq.fills(spark, sf))
    last = ledger.groupBy("series_id").agg(F.max_by(F.struct("held", "avg_price", "price"), F.struct("ts", "fill_id")).alias("p"), F.sum("realized").alias("realized"))
    marked = risk.mark_to_market(last.select("series_id", F.col("p.held").alias("qty"), F.col("p.avg_price").alias("avg_price")), last.select("series_id", F.col("p.price").alias("close")))
    out = risk.exposure_snapshot(marked, ("series_id",), last.select("series_id", "realized"))
    return out.select("series_id", *[F.round(c, 2).alias(c) for c in ("gross", "net", "unrealized", "realized", "total")])
