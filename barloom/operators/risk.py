"""Allocation and risk rules as set operations over many accounts and series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.spans import DAYS, first_rows, renewed, same_keys, schema_of, spanned
from barloom.functions.windows import SERIES, TS, ordered, running
from barloom.operators.indicators import ordered_fold
from barloom.operators.scans import spaced

# --- allocation -------------------------------------------------------------


def tier_allocation(tier: Column, price: Column, ema: Column) -> tuple[Column, Column]:
    """(size, leverage) by volatility tier; never short."""
    size = F.when(tier == "low", 0.95).when(tier == "high", 0.60).when(price > ema, 0.95).otherwise(0.60)
    return size, F.when(tier == "low", 1.25).otherwise(1.0)


def stop_level(tier: Column, price: Column, ema: Column, atr: Column) -> Column:
    return F.when(tier == "low", F.greatest(price - 3 * atr, ema - 0.5 * atr)).when(tier == "high", ema - atr).otherwise(ema - 0.5 * atr)


def signals(bars: DataFrame, least_bars: int = 51) -> DataFrame:
    """Signals from (series_id, ts, close, ema, atr, tier): none before enough
    history, without indicators, or without a tier."""
    size, leverage = tier_allocation(F.col("tier"), F.col("close"), F.col("ema"))
    df = bars.withColumn("_n", F.row_number().over(ordered()))
    df = df.where((F.col("_n") >= least_bars) & (F.col("close") > 0) & F.col("ema").isNotNull() & F.col("atr").isNotNull() & F.col("tier").isNotNull()).drop("_n")
    return df.withColumn("size", size).withColumn("leverage", leverage).withColumn("stop", stop_level(F.col("tier"), F.col("close"), F.col("ema"), F.col("atr")))


def with_uncertainty(sig: DataFrame, least: float = 0.55) -> DataFrame:
    """Half the size and no leverage where the regime is unsure or flickering."""
    unsure = (F.col("probability") < least) | F.col("is_flickering")
    return sig.withColumn("uncertain", unsure).withColumn("size", F.when(F.col("uncertain"), F.col("size") * 0.5).otherwise(F.col("size"))).withColumn("leverage", F.when(F.col("uncertain"), 1.0).otherwise(F.col("leverage")))


def target_weights(names: DataFrame, keys: Sequence[str], budget: str = "budget", most: int = 5, cap: float = 0.15) -> DataFrame:
    """Equal shares of the budget for the first ``most`` names by priority, each capped."""
    w = Window.partitionBy(*keys)
    df = names.withColumn("_r", F.row_number().over(w.orderBy("priority", SERIES))).where((F.col("_r") <= most) & (F.col(budget) > 0))
    return df.withColumn("weight", F.least(F.col(budget) / F.count("*").over(w), F.lit(cap))).drop("_r")


def rebalance_orders(target: DataFrame, held: DataFrame, keys: Sequence[str], threshold: float = 0.10) -> DataFrame:
    """Orders that move held weights to targets: small moves are skipped unless
    the position must be closed."""
    t = target.select(*keys, F.col("weight").alias("target"), F.col("price"), F.col("equity"))
    h = held.select(*keys, F.col("weight").alias("held"))
    df = t.join(h.hint("shuffle_hash"), list(keys), "full_outer").withColumns({"target": F.coalesce("target", F.lit(0.0)), "held": F.coalesce("held", F.lit(0.0))})
    must_exit = (F.col("target") == 0) & (F.col("held") > 0)
    delta = F.col("target") - F.col("held")
    shares = F.floor(F.try_divide(F.abs(delta) * F.col("equity"), F.col("price")))
    df = df.where(must_exit | (F.abs(delta) >= threshold)).withColumn("side", F.when(delta > 0, "buy").otherwise("sell")).withColumn("shares", shares)
    return df.where("shares > 0").select(*keys, "side", "shares", "target", "held")


def hysteresis(targets: DataFrame, threshold: float = 0.10, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Held weight follows the target only on a large enough move or an exit."""

    def fold(g: pd.DataFrame) -> dict[str, np.ndarray]:
        held, out = 0.0, np.empty(len(g))
        for i, t in enumerate(g["target"].to_numpy(float)):
            if abs(t - held) >= threshold or t == 0 and held > 0:
                held = t
            out[i] = held
        return {"held": out}

    return ordered_fold(targets, fold, {"held": "double"}, keys)


def trailing_stop(positions: DataFrame, keys: Sequence[str] = (SERIES, "segment")) -> DataFrame:
    """A stop that only ever rises while a position is open."""
    return positions.withColumn("trailing_stop", F.max("stop").over(running(list(keys))))


def leveraged_target(size: Column, leverage: Column, multiplier: Column, cap: float = 1.25) -> Column:
    return F.least(size * leverage, F.lit(cap)) * multiplier


# --- breakers ---------------------------------------------------------------

NORMAL, REDUCED, HALTED = 0, 1, 2


def posture_multiplier(severity: Column, floor: float = 0.25) -> Column:
    return F.when(severity == HALTED, floor).when(severity == REDUCED, 0.5).otherwise(1.0)


def drawdown_posture(equity: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Posture of each bar from its own return, five bars and the peak; nothing latches."""
    five = ordered(keys).rowsBetween(-4, 0)
    df = equity.withColumn("_five", F.product(1 + F.col("ret")).over(five) - 1).withColumn("_peak", F.max("equity").over(running(keys)))
    down = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.col("_peak")).otherwise(0.0)
    day = F.when(F.col("ret") <= -0.03, HALTED).when(F.col("ret") <= -0.02, REDUCED).otherwise(NORMAL)
    week = F.when(F.col("_five") <= -0.07, HALTED).when(F.col("_five") <= -0.05, REDUCED).otherwise(NORMAL)
    peak = F.when(down >= 0.10, HALTED).otherwise(NORMAL)
    return df.withColumn("severity", F.greatest(day, week, peak)).drop("_five", "_peak")


def latched_breaker(equity: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Worst posture so far of the day and of the ISO week; the peak rule for good.

    Adds the three latches before this bar as well, for events.
    """
    day, week = [*keys, "_day"], [*keys, "_year", "_week"]
    df = equity.withColumns({"_day": F.to_date(TS), "_year": F.expr(f"extract(YEAROFWEEK FROM {TS})"), "_week": F.weekofyear(TS)})
    df = df.withColumn("_d", F.product(1 + F.col("ret")).over(running(day)) - 1).withColumn("_w", F.product(1 + F.col("ret")).over(running(week)) - 1)
    df = df.withColumn("_p", (F.max("equity").over(running(keys)) - F.col("equity")) / F.max("equity").over(running(keys)))
    df = df.withColumn("_ds", F.when(F.col("_d") <= -0.03, HALTED).when(F.col("_d") <= -0.02, REDUCED).otherwise(NORMAL))
    df = df.withColumn("_ws", F.when(F.col("_w") <= -0.07, HALTED).when(F.col("_w") <= -0.05, REDUCED).otherwise(NORMAL))
    df = df.withColumn("_ps", F.when(F.col("_p") >= 0.10, HALTED).otherwise(NORMAL))
    df = df.withColumns({"day_latch": F.max("_ds").over(running(day)), "week_latch": F.max("_ws").over(running(week)), "peak_latch": F.max("_ps").over(running(keys))})
    df = df.withColumn("severity", F.greatest("day_latch", "week_latch", "peak_latch"))
    zero = lambda c: F.coalesce(c, F.lit(NORMAL))
    before = F.greatest(zero(F.lag("day_latch").over(ordered(day))), zero(F.lag("week_latch").over(ordered(week))), zero(F.lag("peak_latch").over(ordered(keys))))
    return df.withColumn("severity_before", before).withColumn("drawdown", F.greatest(-F.col("_d"), -F.col("_w"), F.col("_p"))).drop("_day", "_year", "_week", "_d", "_w", "_p", "_ds", "_ws", "_ps")


def breaker_events(latched: DataFrame) -> DataFrame:
    """Bars that change the posture, against the posture after resets."""
    return latched.where("severity <> severity_before").select(SERIES, TS, F.col("severity_before").alias("from_severity"), F.col("severity").alias("to_severity"), "drawdown", "equity")


def halted_share(postures: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    return postures.groupBy(*keys).agg(F.avg((F.col("severity") == HALTED).cast("double")).alias("halted_share"))


def calm_reentry(equity: DataFrame, bars: int = 3, breach: float = 0.10, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Peak rule with release: after ``bars`` calm bars under breach the peak is
    set to the present equity. Needs columns equity and calm."""

    def fold(g: pd.DataFrame) -> dict[str, np.ndarray]:
        peak, streak = -np.inf, 0
        halted, peaks = np.zeros(len(g), bool), np.empty(len(g))
        for i, (e, c) in enumerate(zip(g["equity"].to_numpy(float), g["calm"].to_numpy(bool), strict=True)):
            peak = max(peak, e)
            down = (peak - e) / peak if peak > 0 else 0.0
            if down >= breach:
                streak = streak + 1 if c else 0
                if bars > 0 and streak >= bars:
                    peak, streak = e, 0
                else:
                    halted[i] = True
            else:
                streak = 0
            peaks[i] = peak
        return {"peak": peaks, "peak_halted": halted}

    return ordered_fold(equity, fold, {"peak": "double", "peak_halted": "boolean"}, keys)


# --- vetoes and sizing ------------------------------------------------------


def position_size(df: DataFrame, cap: float = 0.15, risk: float = 0.01) -> DataFrame:
    """Shares by risk per trade and by weight, with the reason of a rejection.

    Needs equity, price, stop, target and severity.
    """
    weight = F.least(F.greatest(F.col("target"), F.lit(0.0)), F.lit(cap)) * F.when(F.col("severity") == REDUCED, 0.5).otherwise(1.0)
    distance = F.col("price") - F.col("stop")
    by_risk, by_weight = F.try_divide(risk * F.col("equity"), distance), F.try_divide(weight * F.col("equity"), F.col("price"))
    df = df.withColumns({"_risk": by_risk, "_weight": by_weight})
    shares = F.floor(F.least("_risk", "_weight")).cast("long")
    reason = F.when(F.col("severity") == HALTED, "halted").when((F.col("equity") <= 0) | (F.col("price") <= 0) | (distance <= 0), "bad input").when(shares <= 0, "too small")
    df = df.withColumn("reason", reason).withColumn("shares", F.when(F.col("reason").isNull(), shares).otherwise(F.lit(0).cast("long")))
    return df.withColumn("cap", F.when(F.col("reason").isNotNull(), F.lit(None)).when(F.col("_risk") <= F.col("_weight"), "risk").otherwise("weight")).drop("_risk", "_weight")


def exposure_ok(positions: DataFrame, proposed: DataFrame, limit: float = 1.25, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Whether gross exposure and a proposal stay within ``limit`` times equity."""
    gross = positions.groupBy(*keys).agg(F.sum(F.abs("market_value")).alias("gross"))
    df = proposed.join(gross.hint("shuffle_hash"), list(keys), "left").withColumn("gross", F.coalesce("gross", F.lit(0.0)))
    ok = (F.col("equity") > 0) & (F.try_divide(F.col("gross") + F.col("proposed"), F.col("equity")) <= limit + 1e-9)
    return df.withColumn("exposure_ok", F.coalesce(ok, F.lit(False)))


def daily_trade_limit(orders: DataFrame, limit: int = 20, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Whether fewer than ``limit`` trades stood before this one on its day."""
    day = Window.partitionBy(*keys, F.to_date(TS)).orderBy(TS, "order_id")
    return orders.withColumn("trades_before", F.row_number().over(day) - 1).withColumn("allowed", F.col("trades_before") < limit)


def duplicate_veto(orders: DataFrame, keys: Sequence[str], seconds: int = 60) -> DataFrame:
    """Orders with an earlier one of the same keys within ``seconds``."""
    before = Window.partitionBy(*keys).orderBy(TS, "order_id")
    gap = F.col(TS).cast("double") - F.lag(TS).over(before).cast("double")
    return orders.withColumn("is_duplicate", F.coalesce(gap < seconds, F.lit(False)))


def spread_veto(quotes: DataFrame, most: float = 0.005) -> DataFrame:
    both = (F.col("bid") > 0) & F.col("ask").isNotNull()
    wide = F.try_divide(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2) > most
    return quotes.withColumn("vetoed", F.coalesce(both & wide, F.lit(False)))


def gap_budget(equity: Column, stop_distance: Column, share: float = 0.02, gap: float = 3.0) -> Column:
    return F.floor(F.try_divide(share * equity, gap * stop_distance))


def exposure_trim(equity: Column, gross: Column, price: Column, leverage: Column, limit: float = 1.25) -> Column:
    return F.greatest(F.floor(F.try_divide(limit * equity - gross, price * leverage)), F.lit(0))


def leverage_reasons(df: DataFrame, cap: float = 1.25, least: float = 0.55) -> DataFrame:
    """Leverage capped, and brought down to 1 with the list of reasons why.

    A signal may carry its own flag ``uncertain``. Leverage below 1 is never raised.
    """
    unsure = F.col("probability") < least
    if "uncertain" in df.columns:
        unsure = unsure | F.coalesce("uncertain", F.lit(False))
    reasons = F.array_compact(F.array(F.when(unsure, F.lit("uncertain")), F.when(F.col("severity") > 0, F.lit("posture")), F.when(F.col("open_positions") >= 3, F.lit("positions")), F.when(F.col("flicker") > 4, F.lit("flicker"))))
    df = df.withColumn("reasons", reasons)
    return df.withColumn("leverage", F.least("leverage", F.when(F.size("reasons") > 0, 1.0).otherwise(F.lit(cap))))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def max_correlation(returns: DataFrame, candidates: DataFrame, held: DataFrame, rows: int = 60, least: int = 30, block: int = 256) -> DataFrame:
    """Largest signed correlation of each candidate with other held series, over
    the last ``rows`` values of each, where enough dates are shared. Series that
    do not vary correlate with nothing (null). Null values are not shared dates.

    Series are dealt to blocks of about ``block``; the sums of all pairs of two
    blocks are products of their matrices of values and of dates present.
    """
    recent = returns.withColumn("_r", F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc(TS)))).where((F.col("_r") <= rows) & F.col("ret").isNotNull())
    lines = recent.groupBy(SERIES).agg(F.collect_list(F.struct(F.unix_micros(F.col(TS).cast("timestamp")).alias("t"), F.col("ret").cast("double").alias("v"))).alias("line"))
    lines = lines.select(SERIES, F.transform("line", lambda p: p["t"]).alias("times"), F.transform("line", lambda p: p["v"]).alias("values"))
    kind = dict(returns.dtypes)[SERIES]
    counts = [max(1, -(-names.count() // block)) for names in (candidates, held)]

    def dealt(names: DataFrame, side: int) -> DataFrame:
        known = names.select(SERIES).distinct().join(lines.hint("shuffle_hash"), SERIES)
        own, other = ("_a", "_b") if side == 0 else ("_b", "_a")
        return known.select(SERIES, "times", "values", F.pmod(F.xxhash64(SERIES), F.lit(counts[side])).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(counts[1 - side] - 1))).alias(other)).select(SERIES, "times", "values", "_a", "_b")

    def grid(lines_: pd.DataFrame, dates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, there = np.zeros((len(lines_), len(dates))), np.zeros((len(lines_), len(dates)))
        for i, (times, v) in enumerate(zip(lines_["times"], lines_["values"], strict=True)):
            at = np.searchsorted(dates, times)
            x[i, at], there[i, at] = v - v.mean(), 1.0  # shifts change no correlation
        return x, there

    def multiply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame()
        dates = np.unique(np.concatenate([*a["times"], *b["times"]]))
        (x, mx), (y, my) = grid(a, dates), grid(b, dates)
        n = mx @ my.T
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = x @ y.T / n - (x @ my.T) * (mx @ y.T) / n**2
            vx, vy = x**2 @ my.T / n - (x @ my.T / n) ** 2, mx @ (y**2).T / n - (mx @ y.T / n) ** 2
            floor = 1e-18 * np.maximum(np.abs(x).max(), 1e-300) ** 2, 1e-18 * np.maximum(np.abs(y).max(), 1e-300) ** 2
            r = np.where((vx > floor[0]) & (vy > floor[1]), cov / np.sqrt(vx * vy), -np.inf)
        asked = (n >= least) & (a[SERIES].to_numpy()[:, None] != b[SERIES].to_numpy()[None])
        best, some = np.where(asked, r, -np.inf).max(axis=1), asked.any(axis=1)
        if not some.any():
            return pd.DataFrame()
        return pd.DataFrame({"candidate": a[SERIES][some].tolist(), "r": pd.array([None if v == -np.inf else v for v in best[some]], "Float64")})

    pairs = dealt(candidates, 0).groupBy("_a", "_b").cogroup(renewed(dealt(held, 1)).groupBy("_a", "_b")).applyInPandas(multiply, f"candidate {kind}, r double")
    return pairs.groupBy("candidate").agg(F.max("r").alias("max_correlation"))


def held_correlation(signals: DataFrame, held: DataFrame, returns: DataFrame, rows: int = 60, least: int = 30) -> DataFrame:
    """As ``max_correlation``, for each account's candidate against the names which
    that account holds. Only pairs that some account asks for are correlated."""
    recent = returns.withColumn("_r", F.row_number().over(Window.partitionBy(SERIES).orderBy(F.desc(TS)))).where((F.col("_r") <= rows) & F.col("ret").isNotNull())
    asked = signals.select("account", SERIES).distinct().join(held.select("account", F.col(SERIES).alias("other")).hint("shuffle_hash"), "account").where(F.col(SERIES) != F.col("other"))
    x = recent.select(SERIES, TS, F.col("ret").alias("x"))
    y = recent.select(F.col(SERIES).alias("other"), TS, F.col("ret").alias("y"))
    pairs = asked.select(SERIES, "other").distinct().join(x.hint("shuffle_hash"), SERIES).join(y.hint("shuffle_hash"), ["other", TS])
    known = pairs.groupBy(SERIES, "other").agg(correlation("x", "y").alias("r"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return asked.join(known.hint("shuffle_hash"), [SERIES, "other"]).groupBy("account", SERIES).agg(F.max("r").alias("max_correlation"))


def sector_exposure(positions: DataFrame, sectors: DataFrame, keys: Sequence[str] = ("account",)) -> DataFrame:
    known = positions.join(sectors.hint("shuffle_hash"), SERIES).where(F.col("sector").isNotNull())
    return known.groupBy(*keys, "sector").agg(F.sum(F.abs("market_value")).alias("gross"))


# --- replay -----------------------------------------------------------------


def make_folds(counts: DataFrame, train: int = 504, test: int = 126, step: int = 126) -> DataFrame:
    """Walk-forward folds from (series_id, n): half-open ordinals."""
    starts = F.when(F.col("n") > train, F.sequence(F.lit(0), F.col("n") - train - 1, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    folds = counts.withColumn("n", F.col("n").cast("long")).select(SERIES, "n", F.posexplode(starts).alias("fold_id", "train_start"))
    return folds.select(SERIES, "fold_id", "train_start", (F.col("train_start") + train).alias("test_start"), F.least(F.col("train_start") + train + test, F.col("n")).alias("test_end"))


def tag_folds(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars with every fold they train or test in, by ordinal."""
    numbered = bars.withColumn("ordinal", (F.row_number().over(ordered()) - 1).cast("long"))
    wide = folds.select(SERIES, "fold_id", "test_start", F.explode(F.sequence("train_start", F.col("test_end") - 1)).alias("ordinal"))
    joined = numbered.join(wide.hint("shuffle_hash"), [SERIES, "ordinal"])
    return joined.withColumn("part", F.when(F.col("ordinal") < F.col("test_start"), "train").otherwise("test")).drop("test_start")


def bar_return(weights: DataFrame, rf: float = 0.0, credit: bool = False, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Gross return of a bar under the weight held before it."""
    before = F.coalesce(F.lag("weight").over(ordered(keys)), F.lit(0.0))
    gross = before * F.col("ret") + ((1 - before) * rf / 252 if credit else F.lit(0.0))
    return weights.withColumn("gross", gross)


def equity_from_weights(weights: DataFrame, capital: float, base: float = 0.0005, coefficient: float = 0.0, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Equity of a weight path, net of slippage at each change of weight."""
    df = bar_return(weights, keys=keys)
    moved = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(ordered(keys)), F.lit(0.0)))
    natr = F.coalesce(F.col("natr"), F.lit(0.0)) if "natr" in weights.columns else F.lit(0.0)
    df = df.withColumn("slippage", moved * (base + coefficient * F.greatest(natr, F.lit(0.0))))
    df = df.withColumn("net", (1 + F.col("gross")) * (1 - F.col("slippage")) - 1)
    return df.withColumn("equity", capital * F.product(1 + F.col("net")).over(running(keys)))


def replay_portfolio(names: DataFrame, capital: float, base: float = 0.0005, most: int = 5, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Equity of portfolios whose budget is split equally over the first names.

    A row of ``names`` is a name on a bar: series_id, ts, ret, priority, and the
    portfolio's budget and cap. Names beyond ``most`` weigh nothing, as do all
    names on a bar without a budget. Names are summed by bar before the running
    product, so that its window holds a row for each bar only.
    """
    bar = Window.partitionBy(*keys, TS)
    chosen = (F.row_number().over(bar.orderBy("priority", SERIES)) <= most) & (F.col("budget") > 0)
    df = names.withColumn("_in", F.coalesce(chosen, F.lit(False)).cast("int"))
    df = df.withColumn("weight", F.when(F.col("_in") == 1, F.least(F.col("budget") / F.sum("_in").over(bar), F.col("cap"))).otherwise(0.0))
    before = F.coalesce(F.lag("weight").over(ordered([*keys, SERIES])), F.lit(0.0))
    df = df.withColumn("_before", before).groupBy(*keys, TS).agg(F.sum(F.col("_before") * F.col("ret")).alias("gross"), F.sum(F.abs(F.col("weight") - F.col("_before"))).alias("turnover"))
    df = df.withColumn("net", (1 + F.coalesce("gross", F.lit(0.0))) * (1 - base * F.col("turnover")) - 1)
    return df.withColumn("equity", capital * F.product(1 + F.col("net")).over(running(keys)))


def inject_shocks(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Bars of every scenario, with prices scaled from each event's bar onward.

    ``events`` are (scenario_id, series_id, ordinal, shock)."""
    numbered = bars.withColumn("ordinal", (F.row_number().over(ordered()) - 1).cast("long"))
    scenarios = events.select("scenario_id", SERIES).distinct()
    at = events.groupBy("scenario_id", SERIES, F.col("ordinal").cast("long").alias("ordinal")).agg(F.product(1 + F.col("shock")).alias("_m"))
    wide = numbered.join(scenarios.hint("shuffle_hash"), SERIES).join(at.hint("shuffle_hash"), ["scenario_id", SERIES, "ordinal"], "left")
    scale = F.product(F.coalesce("_m", F.lit(1.0))).over(running(["scenario_id", SERIES], ["ordinal"]))
    wide = wide.withColumn("_s", scale)
    return wide.select("scenario_id", SERIES, TS, "ordinal", *[(F.col(c) * F.col("_s")).alias(c) for c in ("open", "high", "low", "close")], "volume")


def replay_allocation(signals: DataFrame, capital: float = 100_000.0, threshold: float = 0.10, base: float = 0.0005, coefficient: float = 0.0, reentry: int = 0, floor: float = 0.25, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """The feedback loop in one fold per group: return, posture, target, hysteresis,
    slippage. Needs ret, target (before posture), natr and calm. Columns ``floor``
    and ``reentry``, constant in a group, take the place of the arguments."""

    def fold(g: pd.DataFrame) -> dict[str, np.ndarray]:
        n = len(g)
        ret, want, natr, calm = g["ret"].to_numpy(float), g["target"].to_numpy(float), np.nan_to_num(g["natr"].to_numpy(float)), g["calm"].to_numpy(bool)
        least, calm_bars = (g[c].iloc[0] if c in g else default for c, default in (("floor", floor), ("reentry", reentry)))
        equity, held, peak, streak, recent = capital, 0.0, capital, 0, []
        curve, weights, postures, moves = np.empty(n), np.empty(n), np.empty(n, np.int32), np.zeros(n, bool)
        for i in range(n):
            gross = held * ret[i]
            equity *= 1 + gross
            recent = [*recent[-4:], gross]
            five = np.prod([1 + r for r in recent]) - 1
            peak = max(peak, equity)
            severity = HALTED if gross <= -0.03 or five <= -0.07 else REDUCED if gross <= -0.02 or five <= -0.05 else NORMAL
            if peak > 0 and (peak - equity) / peak >= 0.10:
                streak = streak + 1 if calm[i] else 0
                if calm_bars and streak >= calm_bars:
                    peak, streak = equity, 0
                else:
                    severity = HALTED
            else:
                streak = 0
            target = want[i] * (least if severity == HALTED else 0.5 if severity == REDUCED else 1.0)
            if abs(target - held) >= threshold or target == 0 and held > 0:
                equity *= 1 - abs(target - held) * (base + coefficient * max(0.0, natr[i]))
                held, moves[i] = target, True
            curve[i], weights[i], postures[i] = equity, held, severity
        return {"equity": curve, "weight": weights, "severity": postures, "is_rebalance": moves}

    return ordered_fold(signals, fold, {"equity": "double", "weight": "double", "severity": "int", "is_rebalance": "boolean"}, keys)


# --- ledger -----------------------------------------------------------------


def fill_ledger(fills: DataFrame, keys: tuple[str, ...] = (SERIES,)) -> DataFrame:
    """Average-cost ledger: quantity, average price and realised result after each
    fill. Sells close at most what is held; an emptied position starts afresh.

    Rows come sorted by series and time, and a task goes through them once: no
    series is a group of its own, and a long one need not fit a worker.
    """
    made = ("held", "avg_price", "realized")
    rows = fills.drop(*made)
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last(TS), F.asc_nulls_last("fill_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, held, avg = None, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = first_rows(batch, keys, before).tolist()
            before = batch.slice(batch.num_rows - 1)
            buys = pc.fill_null(pc.equal(batch.column("side"), "buy"), False).to_pylist()
            qty, price = (pc.cast(batch.column(c), pa.float64(), safe=False).to_numpy(zero_copy_only=False).tolist() for c in ("qty", "price"))
            out = np.empty((3, batch.num_rows))
            quantities, averages, results = [], [], []
            for new, buy, q, p in zip(fresh, buys, qty, price, strict=True):
                if new:
                    held, avg = 0.0, 0.0
                result = 0.0
                if buy:
                    total = held + q
                    paid = held * avg + q * p
                    avg = paid / total if total else paid * np.inf
                    held = total
                elif held > 0:
                    closed = min(q, held)
                    result = (p - avg) * closed
                    held -= closed
                    if held <= 1e-9:
                        held, avg = 0.0, 0.0
                quantities.append(held)
                averages.append(avg)
                results.append(result)
            out[:] = quantities, averages, results
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, from_pandas=True) for x in out]], names=[*batch.schema.names, *made])

    return rows.mapInArrow(run, schema_of(rows, rows.columns, **dict.fromkeys(made, "double")))


def realized_by_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(SERIES, F.to_date(TS).alias("day")).agg(F.sum("realized").alias("realized"))


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    p = prices.select(SERIES, F.col("close").alias("mark"))
    df = positions.join(p.hint("shuffle_hash"), SERIES)
    return df.withColumn("market_value", F.col("qty") * F.col("mark")).withColumn("unrealized", (F.col("mark") - F.col("avg_price")) * F.col("qty"))


def mark_asof(positions: DataFrame, prices: DataFrame, days: float = DAYS) -> DataFrame:
    """Positions (series_id, ts, qty, avg_price) with the last close of their series at
    or before their time, their value and open result; null without an earlier close.

    Both sides are cut into spans of time; what stood at a span's begin comes from
    a table of one row for each span.
    """
    marks = prices.select(SERIES, TS, F.col("close").alias("mark"), F.lit(0).alias("_side")).where(F.col("mark").isNotNull())
    rows = spanned(positions.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True), days)
    ends = rows.where("_side = 0").groupBy(SERIES, "_span").agg(F.max_by("mark", TS).alias("_end"))
    spans = same_keys(rows.select(SERIES, "_span").distinct(), ends, (SERIES, "_span"), "left")
    spans = spans.withColumn("_begin", F.last("_end", ignorenulls=True).over(Window.partitionBy(SERIES).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    here = F.last("mark", ignorenulls=True).over(Window.partitionBy(SERIES, "_span").orderBy(TS, "_side").rowsBetween(Window.unboundedPreceding, 0))
    known = same_keys(rows.withColumn("mark", here).where("_side = 1"), spans, (SERIES, "_span")).withColumn("mark", F.coalesce("mark", "_begin"))
    valued = known.select(*positions.columns, "mark")
    return valued.withColumn("market_value", F.col("qty") * F.col("mark")).withColumn("unrealized", (F.col("mark") - F.col("avg_price")) * F.col("qty"))


def position_weights(marked: DataFrame, equity: Column) -> DataFrame:
    """Market value over the account's equity; 0 where equity is 0."""
    return marked.withColumn("weight", F.coalesce(F.try_divide(F.col("market_value"), equity), F.lit(0.0)))


def exposure_snapshot(marked: DataFrame, keys: Sequence[str] = ("account",), realized: DataFrame | None = None) -> DataFrame:
    """Gross, net and unrealised result; with ``realized`` (keys, realized) the total
    result too, of accounts that hold nothing any more as well."""
    out = marked.groupBy(*keys).agg(F.sum(F.abs("market_value")).alias("gross"), F.sum("market_value").alias("net"), F.sum("unrealized").alias("unrealized"))
    if realized is None:
        return out
    made = realized.groupBy(*keys).agg(F.sum("realized").alias("realized"))
    both = out.join(made.hint("shuffle_hash"), list(keys), "full_outer").na.fill(0.0, ["gross", "net", "unrealized", "realized"])
    return both.withColumn("total", F.col("realized") + F.col("unrealized"))


def reconcile(own: DataFrame, broker: DataFrame, keys: Sequence[str] = (SERIES,), tolerance: float = 1e-6) -> DataFrame:
    """Positions of both sides: which differ, and the broker's quantity as truth."""
    a, b = own.select(*keys, F.col("qty").alias("own_qty")), broker.select(*keys, F.col("qty").alias("broker_qty"))
    df = a.join(b.hint("shuffle_hash"), list(keys), "full_outer").withColumns({"own_qty": F.coalesce("own_qty", F.lit(0.0)), "broker_qty": F.coalesce("broker_qty", F.lit(0.0))})
    return df.withColumn("mismatch", F.abs(F.col("own_qty") - F.col("broker_qty")) > tolerance)


def holding_bars(bars: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Bars since a position was entered; 0 where none is held."""
    flag = F.when((F.col("held") > 0) & (F.coalesce(F.lag("held").over(ordered(keys)), F.lit(0.0)) <= 0), 1).otherwise(0)
    df = bars.withColumn("_flag", flag)
    df = df.withColumn("_seg", F.sum("_flag").over(running(keys)))
    n = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(TS)) - 1
    return df.withColumn("holding_bars", F.when(F.col("held") > 0, n).otherwise(0)).drop("_flag", "_seg")


# --- monitoring -------------------------------------------------------------


def rate_limit(alerts: DataFrame, minutes: float = 15.0, keys: tuple[str, ...] = ("event_key",), days: float = 7) -> DataFrame:
    """Alerts that pass: none of their key passed within the last minutes. A key is
    cut into spans of ``days``."""
    return spaced(alerts, minutes * 60, keys, "alert_id", days)


def feed_gaps(ticks: DataFrame, seconds: float = 300.0, bucket: int = 900) -> DataFrame:
    """Silences longer than ``seconds`` between two ticks of a series.

    ``seq`` orders ticks by time first. A series is cut into spans of ``bucket``
    seconds, so that a hot one is no single task; the last tick before a span comes
    from a table of one row for each span. Ticks without a time are left out.
    """
    ticks = ticks.where(F.col(TS).isNotNull()).withColumn("_span", F.floor(F.col(TS).cast("double") / bucket))
    last = ticks.groupBy(SERIES, "_span").agg(F.max(TS).alias("_end"))
    last = last.select(SERIES, "_span", F.lag("_end").over(Window.partitionBy(SERIES).orderBy("_span")).alias("_before"))
    inside = F.lag(TS).over(Window.partitionBy(SERIES, "_span").orderBy("seq"))
    df = ticks.withColumn("_prev", inside).join(last.hint("shuffle_hash"), [SERIES, "_span"])
    gap = F.col(TS).cast("double") - F.coalesce("_prev", "_before").cast("double")
    return df.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds).drop("_span", "_prev", "_before")


def open_gaps(gaps: DataFrame, sessions: DataFrame, seconds: float = 300.0, days: float = 1.0) -> DataFrame:
    """The open part of silences: a row for each gap and session of its series whose
    overlap is longer than ``seconds``, with start_ts, ts and open_seconds.

    ``gaps`` has series_id, ts (its end) and gap_seconds, ``sessions`` series_id,
    opens and closes. Both are cut at borders of ``days`` and meet by series and
    piece, so that no gap is compared with sessions far from it; pieces of one gap
    and session are added up again. Sessions that overlap each count; those that
    do not close after they open, and rows with nulls, have no open time.
    """
    size = 86400 * days
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    piece = lambda a, b: F.explode(F.sequence(F.floor(a / (size * 1e6)).cast("long"), F.floor((b - 1) / (size * 1e6)).cast("long"))).alias("_piece")
    silent = gaps.select(SERIES, (micros(TS) - F.round(F.col("gap_seconds") * 1e6).cast("long")).alias("_from"), micros(TS).alias("_to")).where("_from < _to").distinct()
    held = sessions.select(SERIES, micros("opens").alias("_opens"), micros("closes").alias("_closes")).where("_opens < _closes").distinct()
    a = silent.select("*", piece(F.col("_from"), F.col("_to")))
    b = held.select("*", piece(F.col("_opens"), F.col("_closes")))
    low = lambda *c: F.greatest(*[F.col(x) for x in c], (F.col("_piece") * (size * 1e6)).cast("long"))
    high = lambda *c: F.least(*[F.col(x) for x in c], ((F.col("_piece") + 1) * (size * 1e6)).cast("long"))
    met = a.join(b.hint("shuffle_hash"), [SERIES, "_piece"]).withColumn("_open", high("_to", "_closes") - low("_from", "_opens")).where("_open > 0")
    whole = met.groupBy(SERIES, "_from", "_to", "_opens", "_closes").agg(F.sum("_open").alias("_open")).where(F.col("_open") > seconds * 1e6)
    return whole.select(SERIES, F.timestamp_micros(F.greatest("_from", "_opens")).alias("start_ts"), F.timestamp_micros(F.least("_to", "_closes")).alias("ts"), (F.col("_open") / 1e6).alias("open_seconds"))


def usage_band(used: Column, limit: Column) -> tuple[Column, Column]:
    """(ratio, band): below half ok, below the limit warn, else breach."""
    ratio = F.when(limit > 0, used / F.when(limit > 0, limit)).otherwise(0.0)
    return ratio, F.when(ratio < 0.5, "ok").when(ratio < 1.0, "warn").otherwise("breach")
