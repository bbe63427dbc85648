"""Queries of regime models: stated ones with SQL of their filter, pooled fits of many series.

The stated model has two states, calm and wild, with the mean of some returns and
0.6 and 1.8 times their deviation; its start and moves are fixed below. SQL walks
the same filter by recursion, so that posteriors, likelihoods and what rests on
them are compared value by value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import gated, ordered
from barloom.operators import decisions as dec
from barloom.operators import indicators as ind
from barloom.operators import pooled
from barloom.operators import regimes as reg
from barloom.operators import risk
from barloom.plans.indicator_queries import _ATR, _EMA
from barloom.plans.report_queries import _FILLS, curve, damped, fills
from barloom.plans.sql import BARS, DAMPED, NUMBERED, RETURNS, with_
from barloom.sources import bars as src

QUERIES: dict = {}
SQL: dict[str, str] = {}
START, MOVES, WIDTHS = (0.5, 0.5), ((0.97, 0.03), (0.10, 0.90)), (0.6, 1.8)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def stated_model(mean: Column, deviation: Column) -> list[Column]:
    """Parameters of the stated model of one feature."""
    row = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    return [
        row(START).alias("startprob"),
        F.array(*map(row, MOVES)).alias("transmat"),
        F.array(*[F.array(mean) for _ in WIDTHS]).alias("means"),
        F.array(*[F.array(F.array(F.pow(deviation * w, 2.0))) for w in WIDTHS]).alias("covars"),
    ]


def filter_sql(rows: str, keys: str, name: str = "fw") -> str:
    """The forward filter over ``rows`` (keys, k from 1, x, m, s) as two CTEs."""
    density = lambda w: f"exp(-0.5 * pow((x - m) / ({w}e0 * s), 2)) / ({w}e0 * s * sqrt(2 * pi()))"
    same = " AND ".join(f"e.{c} = f.{c}" for c in keys.split(", "))
    return f"""{name}_e AS MATERIALIZED (SELECT {keys}, k, {density(WIDTHS[0])} AS e0, {density(WIDTHS[1])} AS e1 FROM {rows}),
{name}({keys}, k, p0, p1, ll) AS (
  SELECT {keys}, k, 0.5e0 * e0 / (0.5e0 * e0 + 0.5e0 * e1), 0.5e0 * e1 / (0.5e0 * e0 + 0.5e0 * e1), ln(0.5e0 * e0 + 0.5e0 * e1) FROM {name}_e WHERE k = 1
  UNION ALL
  SELECT {keys}, k, a0 / (a0 + a1), a1 / (a0 + a1), ln(a0 + a1) FROM (SELECT {", ".join(f"e.{c}" for c in keys.split(", "))}, e.k, (p0 * 0.97e0 + p1 * 0.10e0) * e0 AS a0, (p0 * 0.03e0 + p1 * 0.90e0) * e1 AS a1 FROM {name} f JOIN {name}_e e ON {same} AND e.k = f.k + 1))"""


BLOCKS = DAMPED + """,
o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM damped),
v AS (SELECT series_id, (k - 1) // 250 AS version, min(ts) AS ts, avg(ret) AS m, stddev_samp(ret) AS s, count(*) AS n_rows FROM o GROUP BY 1, 2)"""


def versions(spark, sf) -> DataFrame:
    """A model version for each 250 bars of a series: its rows, mean and deviation."""
    numbered = damped(spark, sf).withColumn("version", F.floor((F.row_number().over(ordered()) - 1) / 250))
    return numbered.groupBy("series_id", "version").agg(F.min("ts").alias("ts"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("*").alias("n_rows"))


def posteriors(spark, sf) -> DataFrame:
    """Every bar under the stated model of its series' first version."""
    models = versions(spark, sf).where("version = 0").select("series_id", *stated_model(F.col("m"), F.col("s")))
    return reg.regime_proba(damped(spark, sf), models, ("ret",))


_FIRST = BLOCKS + ", x AS (SELECT o.series_id, k, ret AS x, m, s FROM o JOIN v ON v.series_id = o.series_id AND version = 0), " + filter_sql("x", "series_id")


@query("c5_c7_stated_filter", with_(_FIRST, "SELECT o.series_id, ts, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS state_id, round(p0, 6) AS calm, round(ll, 6) AS log_likelihood FROM o JOIN fw ON fw.series_id = o.series_id AND fw.k = o.k", True))
def c7(spark, sf):
    scored = posteriors(spark, sf).withColumn("calm", F.get("probabilities", 0))
    return six(scored, "calm", "log_likelihood").select("series_id", "ts", "state_id", "calm", "log_likelihood")


@query("c19_posterior_entropy", with_(_FIRST, "SELECT o.series_id, ts, round(-(CASE WHEN p0 > 0 THEN p0 * ln(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * ln(p1) ELSE 0 END) / ln(2), 6) AS entropy FROM o JOIN fw ON fw.series_id = o.series_id AND fw.k = o.k", True))
def c19(spark, sf):
    return six(posteriors(spark, sf).withColumn("entropy", reg.posterior_entropy(F.col("probabilities"))), "entropy").select("series_id", "ts", "entropy")


#: Champion and challenger, the first two versions, on the last 252 bars.
SCORED = BLOCKS + """,
tail AS (SELECT series_id, ret AS x, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS back FROM damped),
tailv AS (SELECT q.series_id, version, 253 - back AS k, x, m, s FROM tail q JOIN v ON v.series_id = q.series_id WHERE back <= 252 AND version < 2), """ + filter_sql("tailv", "series_id, version") + """,
ml AS (SELECT series_id, version, avg(ll) AS mean_ll FROM fw GROUP BY 1, 2),
ch AS (SELECT n.series_id, n.ts, n.n_rows, c.mean_ll AS champion_ll, w.mean_ll, CASE WHEN n.n_rows < 200 THEN 'too few rows' WHEN NOT n.s > 0 THEN 'not converged' WHEN c.mean_ll IS NULL THEN 'no champion' WHEN w.mean_ll IS NULL THEN 'scoring failed' WHEN w.mean_ll >= c.mean_ll - 1e-9 THEN 'at least as likely' ELSE 'less likely' END AS reason
  FROM v n LEFT JOIN ml w ON w.series_id = n.series_id AND w.version = 1 LEFT JOIN ml c ON c.series_id = n.series_id AND c.version = 0 WHERE n.version = 1)"""


def challenge(spark, sf) -> DataFrame:
    """The decision on each series' second version, by likelihoods of its last bars."""
    v = versions(spark, sf).where("version < 2")
    tail = src.latest_bars(damped(spark, sf), 252).withColumn("version", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    keys = ("series_id", "version")
    scored = reg.mean_log_likelihood(reg.regime_proba(tail, v.select(*keys, *stated_model(F.col("m"), F.col("s"))), ("ret",), keys), keys)
    known = v.join(scored.hint("shuffle_hash"), list(keys), "left").withColumn("converged", F.coalesce(F.col("s") > 0, F.lit(False)))
    return reg.promote_challenger(known.where("version = 0 and mean_ll is not null"), known.where("version = 1"), least_rows=200)


@query("c14_promote_challenger", with_(SCORED, "SELECT series_id, reason, reason IN ('no champion', 'at least as likely') AS promoted FROM ch", True))
def c14(spark, sf):
    return challenge(spark, sf).select("series_id", "reason", "promoted")


@query("c13_mean_log_likelihood", with_(SCORED, "SELECT series_id, round(champion_ll, 6) AS champion_ll, round(mean_ll, 6) AS mean_ll FROM ch", True))
def c13(spark, sf):
    return six(challenge(spark, sf), "champion_ll", "mean_ll").select("series_id", "champion_ll", "mean_ll")


@query("c12_learned_transitions", with_(BARS, "SELECT series_id, i AS from_state, j AS to_state, CASE WHEN i = 0 THEN CASE WHEN j = 0 THEN 0.97e0 ELSE 0.03e0 END ELSE CASE WHEN j = 0 THEN 0.1e0 ELSE 0.9e0 END END AS probability FROM (SELECT DISTINCT series_id FROM bars), range(2) a(i), range(2) b(j)"))
def c12(spark, sf):
    models = versions(spark, sf).where("version = 0").select("series_id", *stated_model(F.col("m"), F.col("s")))
    return reg.transition_table(models)


# --- decisions and marks ----------------------------------------------------


@query(
    "a11_decision_context",
    with_(
        _FIRST + f""",
dc AS (SELECT c.series_id, c.ts, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS regime, greatest(p0, p1) AS probability, equity, equity - lag(equity) OVER (PARTITION BY c.series_id ORDER BY c.ts) AS day_result, equity * CASE WHEN p1 > p0 THEN 0.6e0 ELSE 0.95e0 END AS exposure, row_number() OVER (PARTITION BY c.series_id ORDER BY c.ts DESC) AS r
  FROM curve c JOIN o ON o.series_id = c.series_id AND o.ts = c.ts JOIN fw ON fw.series_id = o.series_id AND fw.k = o.k)""",
        "SELECT series_id, ts, 'regime' AS event, regime, round(probability, 6) AS probability, round(equity, 2) AS equity, round(day_result, 2) AS day_result, round(exposure, 2) AS exposure FROM dc WHERE r <= 20",
        True,
    ),
)
def a11(spark, sf):
    """The last twenty lines of a log of every bar's regime and what it was decided on."""
    scored = posteriors(spark, sf).select("series_id", "ts", F.col("state_id").alias("regime"), "probability")
    path = curve(spark, sf).select("series_id", "ts", "equity", (F.col("equity") - F.lag("equity").over(ordered())).alias("day_result"))
    made = scored.join(path.hint("shuffle_hash"), ["series_id", "ts"]).withColumn("exposure", F.col("equity") * F.when(F.col("regime") == 1, 0.6).otherwise(0.95)).withColumn("event", F.lit("regime"))
    recent = dec.recent_decisions(dec.decision_lines(made))
    return recent.withColumns({c: F.round(c, 6 if c == "probability" else 2) for c in ("probability", "equity", "day_result", "exposure")})


@query(
    "h3_marks_asof",
    with_(
        _FILLS + ", pr AS (SELECT series_id, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS pt, arg_max(price, n) AS mark FROM o GROUP BY 1, 2), x AS (SELECT o.series_id, o.fill_id, o.ts, held, avg_price FROM o JOIN ledger USING (series_id, n))",
        "SELECT x.series_id, fill_id, floor(mark * 10000) / 10000 AS mark, floor(held * mark * 100) / 100 AS market_value FROM x ASOF LEFT JOIN pr ON pr.series_id = x.series_id AND x.ts >= pr.pt",
        True,
    ),
)
def h3(spark, sf):
    """Each supplier's position after each fill, at the last close of a day before."""
    lines = fills(spark, sf)
    positions = risk.fill_ledger(lines).select("series_id", "fill_id", "ts", F.col("held").alias("qty"), "avg_price")
    closes = lines.groupBy("series_id", F.date_trunc("day", "ts").alias("d")).agg(F.max_by("price", F.struct("ts", "fill_id")).alias("close")).select("series_id", (F.col("d") + F.expr("INTERVAL 1 DAY")).alias("ts"), "close")
    down = lambda c, k: (F.floor(F.col(c) * k) / k).alias(c)
    return risk.mark_asof(positions, closes).select("series_id", "fill_id", down("mark", 10000), down("market_value", 100))


# --- one regime for the market ----------------------------------------------


def market_regimes(spark, sf) -> DataFrame:
    """ts, tier, probability and flicker of the market: the mean return of all series
    under the stated model of its first 250 bars. The calm state is the low tier."""
    market = damped(spark, sf).groupBy("ts").agg(F.avg("ret").alias("ret")).select(F.lit("market").alias("series_id"), "ts", "ret")
    first = market.withColumn("_k", F.row_number().over(ordered())).where("_k <= 250").groupBy("series_id").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    scored = reg.with_flicker(reg.regime_proba(market, first.select("series_id", *stated_model(F.col("m"), F.col("s"))), ("ret",)))
    return scored.select("ts", F.when(F.col("vol_rank") >= reg.HIGH_CUT, "high").when(F.col("vol_rank") <= reg.LOW_CUT, "low").otherwise("mid").alias("tier"), "probability", "is_flickering")


_MARKET = (
    _ATR
    + _EMA[len(NUMBERED) :]
    + RETURNS[len(BARS) :]
    + """,
mk AS (SELECT ts, avg(ret / 100) AS x, row_number() OVER (ORDER BY ts) AS k FROM rets GROUP BY 1),
mm AS (SELECT 'market' AS series_id, k, x, (SELECT avg(x) FROM mk WHERE k <= 250) AS m, (SELECT stddev_samp(x) FROM mk WHERE k <= 250) AS s FROM mk), """
    + filter_sql("mm", "series_id")
    + """,
ms AS (SELECT ts, fw.k, p0, p1, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS st FROM fw JOIN mk ON mk.k = fw.k),
mc AS (SELECT *, CASE WHEN lag(st) OVER (ORDER BY k) <> st THEN 1 ELSE 0 END AS c FROM ms),
mr AS (SELECT ts, st, greatest(p0, p1) AS probability, sum(c) OVER (ORDER BY k ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) > 4 AS hot FROM mc),
mj AS (SELECT b.series_id, b.ts, b.close AS price, e, a, st, probability < 0.55 OR hot AS uncertain FROM numbered b JOIN ema USING (series_id, bar_no) JOIN atr USING (series_id, bar_no) JOIN mr ON mr.ts = b.ts WHERE b.bar_no >= 51 AND b.close > 0)"""
)


@query(
    "d5_market_signals",
    with_(_MARKET, "SELECT series_id, ts, CASE st WHEN 0 THEN 'low' ELSE 'high' END AS tier, (CASE st WHEN 0 THEN 0.95e0 ELSE 0.60e0 END) * (CASE WHEN uncertain THEN 0.5e0 ELSE 1 END) AS size, CASE WHEN st = 0 AND NOT uncertain THEN 1.25e0 ELSE 1.0e0 END AS leverage, round(CASE st WHEN 0 THEN greatest(price - 3 * a, e - 0.5 * a) ELSE e - a END, 4) AS stop, uncertain FROM mj", True),
)
def d5(spark, sf):
    bars = ind.add_recurrences(src.daily_bars(spark, sf)).select("series_id", "ts", "close", "ema", "atr")
    found = risk.with_uncertainty(risk.signals(bars.join(market_regimes(spark, sf).hint("shuffle_hash"), "ts", "left")))
    return found.select("series_id", "ts", "tier", "size", "leverage", F.round("stop", 4).alias("stop"), "uncertain")


# --- one model for many series ----------------------------------------------


def supplier_features(spark, sf) -> DataFrame:
    """Log-returns of each supplier's daily closes and their deviation over ten bars."""
    lines = src.read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber", "l_partkey")
    close = lines.groupBy("series_id", F.date_trunc("day", "ts").alias("ts")).agg(F.max_by("price", F.struct("ts", "l_orderkey", "l_linenumber", "l_partkey", "price")).alias("close"))
    ret = close.withColumn("ret", ind.log_return(1))
    return ret.withColumn("vol", gated(F.stddev_samp, "ret", 10)).select("series_id", "ts", "ret", "vol").na.drop()


def pooled_models(spark, sf) -> DataFrame:
    """Two and three states for all suppliers together; a gain of a hundredth of a
    thousandth a row ends a fit."""
    features = supplier_features(spark, sf)
    return pooled.fit_pooled_models(features, ("ret", "vol"), ((2, 42), (3, 42)), gain=1e-5, row_gain=1e-5)


@query("c1_pooled_models")
def c1(spark, sf):
    fits = pooled_models(spark, sf).withColumn("bic", reg.bic(F.col("n"), 2, F.col("log_likelihood"), F.col("n_rows")))
    return fits.select("n", "seed", "n_rows", F.round("log_likelihood", 2).alias("log_likelihood"), F.round("bic", 2).alias("bic"), F.size("trace").alias("iterations"), "converged")


@query("c7_pooled_regimes")
def c7_pooled(spark, sf):
    """Each supplier's last state under the pooled model of least BIC, how likely its
    bars are and how sure the state is."""
    features = supplier_features(spark, sf)
    best = reg.select_model(pooled_models(spark, sf).withColumn("model", F.lit("pooled")), 2, ("model",)).first()  # one row: a model
    # too few rows for a fit: no model, no row
    features, model = (features, reg.unpack(best)) if best else (features.limit(0), (np.ones(1), np.ones((1, 1)), np.zeros((1, 2)), np.eye(2)[None]))
    scored = reg.with_runs(pooled.score_pooled(features, model, ("ret", "vol")))
    last = scored.groupBy("series_id").agg(F.count("*").alias("bars"), F.avg("log_likelihood").alias("mean_ll"), F.max_by(F.struct("state_id", "probability", "probabilities", "consecutive_bars"), "ts").alias("s"))
    last = last.select("series_id", "bars", "mean_ll", "s.state_id", "s.probability", "s.consecutive_bars", reg.posterior_entropy(F.col("s.probabilities")).alias("entropy"))
    return six(last, "mean_ll", "probability", "entropy")
