"""Queries of model selection, drawn stress events, probes and the skill test."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.windows import gated, running
from barloom.operators import probes
from barloom.operators import regimes as reg
from barloom.plans.report_queries import CAPITAL, damped
from barloom.plans.sql import DAMPED, S, gated as sql_gated, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Simulations of each probe; every one refits all folds of all series.
SIMS = 3


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def returns(spark, sf):
    return damped(spark, sf).select("series_id", "ts", "ret").withColumn("_a", F.abs("ret")).withColumn("natr", gated(F.avg, "_a", 14)).drop("_a")


def _uniform(purpose: int) -> str:
    return f"((scenario_id * 7919 + draw * 104729 + scenario_id * draw * 31 + ascii(series_id) * 613 + {purpose} * 7727) % 1009) / 1009.0e0"


def events(spark, sf):
    """Crash and gap events of the probes."""
    rows = probes.numbered(returns(spark, sf))
    counts = rows.groupBy("series_id").agg(F.count("*").alias("n"))
    drawn = lambda per: probes.draw_events(counts, SIMS, per, lambda purpose: F.expr(_uniform(purpose)))
    return rows, probes.crash_events(drawn(10)), probes.gap_events(drawn(5), rows)


_DRAWN = DAMPED + f""",
r AS (SELECT series_id, ts, row_number() OVER ({S}) - 1 AS ordinal, abs(ret) AS a FROM damped), nr AS (SELECT series_id, ordinal, {sql_gated('avg', 'a', 14)} AS natr FROM r),
c AS (SELECT series_id, count(*) AS n, least(count(*) // 2, greatest(260, count(*) // 4)) AS lo FROM damped GROUP BY 1),
b AS (SELECT series_id, CASE WHEN n - 2 > lo THEN lo ELSE n // 2 END AS lo, CASE WHEN n - 2 > lo THEN n - 2 ELSE n - 1 END AS hi FROM c),
d AS (SELECT series_id, lo, hi, scenario_id, draw FROM b CROSS JOIN (SELECT unnest(range(1, {SIMS + 1})) AS scenario_id) CROSS JOIN (SELECT unnest(range(1, 11)) AS draw) WHERE hi > lo),
e AS (SELECT series_id, scenario_id, draw, CAST(lo + floor({_uniform(0)} * (hi - lo)) AS BIGINT) AS ordinal, {_uniform(1)} AS u FROM d)"""


@query(
    "f11_draw_events",
    with_(
        _DRAWN,
        """SELECT 'crash' AS probe, scenario_id, series_id, ordinal, round(-0.15e0 + 0.1e0 * u, 6) AS shock FROM e
UNION ALL SELECT 'gap', scenario_id, e.series_id, e.ordinal, round(-(2 + 3 * u) * coalesce(natr, 0), 6) FROM e JOIN nr ON nr.series_id = e.series_id AND nr.ordinal = e.ordinal WHERE draw <= 5""",
    ),
)
def f11(spark, sf):
    _, crash, gap = events(spark, sf)
    both = crash.withColumn("probe", F.lit("crash")).unionByName(gap.withColumn("probe", F.lit("gap")))
    return six(both, "shock").select("probe", "scenario_id", "series_id", "ordinal", "shock")


def maps(spark, sf):
    return probes.shuffled_maps(probes.walked(returns(spark, sf).withColumn("scenario_id", F.lit(0))), SIMS)


@query("f12_stress_probes")
def f12(spark, sf):
    rows, crash, gap = events(spark, sf)
    report = probes.shock_probe(rows, crash, "crash", CAPITAL).unionByName(probes.shock_probe(rows, gap, "gap", CAPITAL))
    report = report.unionByName(probes.misclassification_probe(maps(spark, sf), CAPITAL))
    return six(report, "mean_max_loss", "worst_max_loss", "fired_rate", "blow_up_rate", "expected_loss")


@query("f17_skill_test")
def f17(spark, sf):
    return six(probes.skill_test(maps(spark, sf), CAPITAL), "real_return", "shuffled_return", "real_sharpe", "shuffled_sharpe", "margin_return", "margin_sharpe")


def model_grid(spark, sf):
    features = damped(spark, sf).withColumn("vol", F.stddev_samp("ret").over(running().rowsBetween(-19, 0))).na.drop()
    return reg.fit_model_grid(features, ("ret", "vol"), (3, 4, 5), (42, 43))


@query("c2_select_model")
def c2(spark, sf):
    chosen = reg.select_model(model_grid(spark, sf), 2)
    return chosen.select("series_id", "n", "seed", "n_rows", F.round("log_likelihood", 4).alias("log_likelihood"), F.round("bic", 4).alias("bic"), "converged")
