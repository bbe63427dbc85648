"""Stress probes and the skill test: drawn shocks and shuffled maps, replayed side by side.

A simulation of a series is a path. Paths are keyed by (scenario, series), so
that all simulations of all series are fitted and replayed as groups of one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import SERIES, TS, ordered, running, trailing
from barloom.operators import indicators as ind
from barloom.operators import regimes as reg
from barloom.operators import risk
from barloom.operators.decisions import path_summary, stress_report

CRASH, GAP = (-0.15, -0.05), (2.0, 5.0)
WARMUP = 260


def hashed(seed: int) -> Callable[[int], Column]:
    """Uniforms from 0 to below 1 by hash of the path and the draw's number."""
    return lambda purpose: F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), SERIES, "scenario_id", "draw"), F.lit(1 << 53)) / float(1 << 53)


def draw_events(counts: DataFrame, sims: int, per: int, uniform: Callable[[int], Column]) -> DataFrame:
    """Places and sizes of ``per`` events in each of ``sims`` simulations.

    ``counts`` is (series_id, n). Places lie past the warm-up and before the last
    two bars, or in the last half where that leaves none; series of fewer than
    two bars have none. ``u``, from 0 to 1, is the size.
    """
    n, half = F.col("n").cast("long"), F.floor(F.col("n") / 2)
    low = F.least(half, F.greatest(F.lit(WARMUP), F.floor(F.col("n") / 4)))
    usual = n - 2 > low
    wide = counts.withColumns({"_lo": F.when(usual, low).otherwise(half), "_hi": F.when(usual, n - 2).otherwise(n - 1)}).where("_hi > _lo")
    wide = wide.withColumn("scenario_id", F.explode(F.sequence(F.lit(1), F.lit(sims)).cast("array<bigint>")))
    wide = wide.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per)).cast("array<bigint>")))
    place = F.col("_lo") + F.floor(uniform(0) * (F.col("_hi") - F.col("_lo")))
    return wide.select("scenario_id", SERIES, "draw", place.cast("long").alias("ordinal"), uniform(1).alias("u"))


def crash_events(draws: DataFrame) -> DataFrame:
    return draws.withColumn("shock", CRASH[0] + (CRASH[1] - CRASH[0]) * F.col("u"))


def gap_events(draws: DataFrame, natr: DataFrame) -> DataFrame:
    """Falls of two to five times the range at the event's bar (none before it is known)."""
    at = draws.join(natr.select(SERIES, "ordinal", "natr").hint("shuffle_hash"), [SERIES, "ordinal"])
    return at.withColumn("shock", -(GAP[0] + (GAP[1] - GAP[0]) * F.col("u")) * F.coalesce("natr", F.lit(0.0))).drop("natr")


def numbered(returns: DataFrame) -> DataFrame:
    return returns.withColumn("ordinal", (F.row_number().over(ordered()) - 1).cast("long"))


def shocked_returns(returns: DataFrame, events: DataFrame) -> DataFrame:
    """Numbered returns of every simulation; an event scales its bar's growth, and
    so all later prices. Several events of one bar multiply."""
    at = events.groupBy("scenario_id", SERIES, "ordinal").agg(F.product(1 + F.col("shock")).alias("_m"))
    paths = events.select("scenario_id", SERIES).distinct()
    wide = returns.join(paths.hint("shuffle_hash"), SERIES).join(at.hint("shuffle_hash"), ["scenario_id", SERIES, "ordinal"], "left")
    return wide.withColumn("ret", (1 + F.col("ret")) * F.coalesce("_m", F.lit(1.0)) - 1).drop("_m", "ordinal")


def walked(paths: DataFrame, n: int = 3) -> DataFrame:
    """Regime states of the walk-forward test bars of each path (scenario_id,
    series_id, ts, ret, natr), with the path's price and its average."""
    path = F.concat_ws("|", F.col("scenario_id").cast("string"), F.col(SERIES))
    df = paths.withColumns({"name": F.col(SERIES), SERIES: path})
    df = df.withColumns({"vol": F.stddev_samp("ret").over(trailing(20)), "price": F.product(1 + F.col("ret")).over(running())})
    df = ind.add_ema(df, column="price").na.drop(subset=["ret", "vol"])
    folds = risk.make_folds(df.groupBy(SERIES).agg(F.count("*").alias("n")))
    return reg.walk_forward_states(risk.tag_folds(df, folds), ("ret", "vol"), n)


def with_tier(states: DataFrame) -> DataFrame:
    rank = F.col("vol_rank")
    return states.withColumn("tier", F.when(rank <= reg.LOW_CUT, "low").when(rank >= reg.HIGH_CUT, "high").otherwise("mid"))


def shuffled_maps(states: DataFrame, seeds: int) -> DataFrame:
    """Test bars with their tier under seed 0, and under each shuffled map of the fold's states."""
    wide = with_tier(states).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds))))
    other = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("tier_no") + 1)
    return reg.permuted_tiers(wide, F.col("seed")).withColumn("tier", F.when(F.col("seed") == 0, F.col("tier")).otherwise(other)).drop("tier_no")


def replayed(tiered: DataFrame, capital: float, floor: float = 0.25, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """The allocation of each tier, replayed; net is the bar's return after slippage."""
    size, leverage = risk.tier_allocation(F.col("tier"), F.col("price"), F.col("ema"))
    df = tiered.withColumns({"target": risk.leveraged_target(size, leverage, F.lit(1.0)), "calm": F.col("vol_rank") < reg.HIGH_CUT})
    out = risk.replay_allocation(df.select(*keys, "name", "scenario_id", TS, "ret", "natr", "target", "calm"), capital, floor=floor, keys=keys)
    return out.withColumn("net", F.col("equity") / F.coalesce(F.lag("equity").over(ordered(keys)), F.lit(capital)) - 1)


def shock_probe(returns: DataFrame, events: DataFrame, probe: str, capital: float) -> DataFrame:
    """Report of the replays over shocked paths, and the mean of the injected shocks' sum."""
    paths = replayed(with_tier(walked(shocked_returns(returns, events))), capital)
    injected = events.groupBy("scenario_id", SERIES).agg(F.sum("shock").alias("s")).groupBy(F.col(SERIES).alias("name")).agg(F.avg("s").alias("expected_loss"))
    report = stress_report(paths, ["scenario_id"], ["name"])
    return report.join(injected.hint("shuffle_hash"), "name").withColumn("probe", F.lit(probe))


def misclassification_probe(maps: DataFrame, capital: float) -> DataFrame:
    """Report of the replays under shuffled maps (seeds above 0)."""
    paths = replayed(maps.where("seed > 0"), capital, keys=(SERIES, "seed"))
    return stress_report(paths, ["seed"], ["name"]).withColumns({"expected_loss": F.lit(None).cast("double"), "probe": F.lit("misclassification")})


def skill_test(maps: DataFrame, capital: float) -> DataFrame:
    """The real map against the shuffled ones, without a halt (floor 1)."""
    scores = path_summary(replayed(maps, capital, floor=1.0, keys=(SERIES, "seed")), "net", capital, ("name", "seed"))
    real = F.col("seed") == 0
    wide = scores.groupBy("name").agg(
        F.max(F.when(real, F.col("total_return"))).alias("real_return"),
        F.avg(F.when(~real, F.col("total_return"))).alias("shuffled_return"),
        F.max(F.when(real, F.col("sharpe"))).alias("real_sharpe"),
        F.avg(F.when(~real, F.col("sharpe"))).alias("shuffled_sharpe"),
        F.sum((~real).cast("int")).alias("shuffles"),
    )
    return wide.withColumns({"margin_return": F.col("real_return") - F.col("shuffled_return"), "margin_sharpe": F.col("real_sharpe") - F.col("shuffled_sharpe")})
