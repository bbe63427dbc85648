"""Decision rules over whole tables: vetoes, order intents, stress and benchmark reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import SERIES, TS, ordered, running
from barloom.operators import performance as perf
from barloom.operators.risk import HALTED, REDUCED, daily_trade_limit, duplicate_veto, exposure_trim, gap_budget, held_correlation, leverage_reasons, sector_exposure

LEAST_NOTIONAL = 100.0
LEVELS = (0.0, 0.60, 0.95, 1.1875)


def with_account_state(signals: DataFrame, accounts: DataFrame, positions: DataFrame, orders: DataFrame, sectors: DataFrame, returns: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Signals (order_id, account, series_id) with what the cascade asks of their account.

    ``accounts`` has a row for each account (equity, buying_power, severity, locked),
    ``positions`` one for each account and name (market_value), ``orders`` every
    order sent, the signals' own among them (order_id, account, series_id, side,
    ts), ``sectors`` a row for each name, ``returns`` (series_id, ts, ret).
    An account without positions has exposure 0; a name without a sector has a null
    ``sector_gross``. An account that is not known has no equity, so it is not sized.
    """
    held = positions.where("market_value <> 0")
    book = held.groupBy("account").agg(F.sum(F.abs("market_value")).alias("gross"), F.count("*").alias("open_positions"))
    by_sector = sector_exposure(held, sectors).withColumnRenamed("gross", "sector_gross")
    sent = duplicate_veto(daily_trade_limit(orders), ("account", SERIES, "side"), seconds).select("order_id", "is_duplicate", "trades_before")
    df = signals.join(accounts.hint("shuffle_hash"), "account", "left").join(book.hint("shuffle_hash"), "account", "left")
    df = df.join(held.select("account", SERIES, F.lit(True).alias("is_held")).hint("shuffle_hash"), ["account", SERIES], "left")
    df = df.join(sectors.hint("shuffle_hash"), SERIES, "left").join(by_sector.hint("shuffle_hash"), ["account", "sector"], "left")
    df = df.join(held_correlation(signals, held, returns).hint("shuffle_hash"), ["account", SERIES], "left")
    df = df.join(sent.hint("shuffle_hash"), "order_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.withColumns(
        {
            "gross": zero("gross"),
            "open_positions": zero("open_positions"),
            "trades_before": zero("trades_before"),
            "is_held": F.coalesce("is_held", F.lit(False)),
            "is_duplicate": F.coalesce("is_duplicate", F.lit(False)),
            "severity": zero("severity"),
            "locked": F.coalesce("locked", F.lit(False)),
            "sector_gross": F.when(F.col("sector").isNotNull(), zero("sector_gross")),
        }
    )


def veto_cascade(signals: DataFrame, cap: float = 0.15, limit: float = 1.25, most_sector: float = 0.30) -> DataFrame:
    """Approved shares and leverage of each signal, or the first rule it fails.

    A wide row holds the signal and its account's state: locked, severity, side,
    price, stop, tradable, bid, ask, is_duplicate, trades_before, is_held,
    open_positions, probability, flicker, leverage, target, equity, gross,
    buying_power, max_correlation (null: none) and sector_gross (null: no
    sector), as ``with_account_state`` joins them. Trims are listed in ``modifications``.
    """
    price, equity = F.col("price"), F.col("equity")
    distance = price - F.col("stop")
    wide = F.try_divide(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2) > 0.005
    early = (
        F.when(F.col("locked") | (F.col("severity") == HALTED), "halted")
        .when(F.col("side") != "buy", "long only")
        .when(F.col("stop").isNull() | (F.col("stop") <= 0), "no stop")
        .when(distance <= 0, "stop distance")
        .when(~F.col("tradable"), "not tradable")
        .when((F.col("bid") > 0) & wide, "spread")
        .when(F.col("is_duplicate"), "duplicate")
        .when(F.col("trades_before") >= 20, "daily limit")
        .when(~F.col("is_held") & (F.col("open_positions") >= 5), "concurrency")
    )
    df = signals.withColumn("_early", early).withColumn("_asked", F.least("leverage", F.lit(limit)))
    df = leverage_reasons(df, limit)

    weight = F.least(F.greatest(F.col("target"), F.lit(0.0)), F.lit(cap)) * F.when(F.col("severity") == REDUCED, 0.5).otherwise(1.0)
    df = df.withColumn("_sized", F.floor(F.least(F.try_divide(0.01 * equity, distance), F.try_divide(weight * equity, price))))
    df = df.withColumn("_gapped", F.least("_sized", gap_budget(equity, distance)))
    small = lambda shares: shares * price < LEAST_NOTIONAL
    over = ~((equity > 0) & (F.try_divide(F.col("gross") + F.col("_gapped") * price * F.col("leverage"), equity) <= limit + 1e-9))
    df = df.withColumn("_over", over)
    df = df.withColumn("_fitted", F.when(F.col("_over"), exposure_trim(equity, F.col("gross"), price, F.col("leverage"), limit)).otherwise(F.col("_gapped")))
    df = df.withColumn("_close", F.coalesce(F.col("max_correlation") > 0.70, F.lit(False)))
    df = df.withColumn("_final", F.when(F.col("_close"), F.floor(F.col("_fitted") * 0.5)).otherwise(F.col("_fitted")))
    late = (
        F.when(F.coalesce(F.col("_sized") <= 0, F.lit(True)), "sizing")
        .when(small(F.col("_gapped")), "least notional")
        .when(F.col("_over") & ((F.col("_fitted") <= 0) | small(F.col("_fitted"))), "exposure")
        .when((F.col("buying_power") != 0) & (F.col("_fitted") * price * F.col("leverage") > F.col("buying_power")), "buying power")
        .when(F.col("max_correlation") > 0.85, "correlation")
        .when(F.col("_close") & small(F.col("_final")), "least notional")
        .when(F.try_divide(F.col("sector_gross") + F.col("_final") * price, F.greatest(equity, F.lit(1e-9))) > most_sector, "sector")
    )
    changed = F.array_compact(
        F.array(
            F.when((F.size("reasons") > 0) & (F.col("_asked") > 1), F.lit("leverage")),
            F.when(F.col("_gapped") < F.col("_sized"), F.lit("gap")),
            F.when(F.col("_over"), F.lit("exposure")),
            F.when(F.col("_close"), F.lit("correlation")),
        )
    )
    df = df.withColumn("reason", F.coalesce("_early", late)).withColumn("approved", F.col("reason").isNull())
    df = df.withColumn("shares", F.when(F.col("approved"), F.col("_final").cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("modifications", F.when(F.col("approved"), F.concat_ws(",", changed)).otherwise(""))
    return df.drop("_early", "_asked", "_sized", "_gapped", "_over", "_fitted", "_close", "_final", "reasons")


def order_intents(approved: DataFrame, offset: float = 0.001) -> DataFrame:
    """Orders to be placed by somebody else: a take-profit at twice the risk where
    none is given, and a marketable limit. Rows without shares or stop are left out."""
    take = F.coalesce("take_profit", F.col("price") + 2 * (F.col("price") - F.col("stop")))
    limit = F.col("price") * F.when(F.col("side") == "buy", 1 + offset).otherwise(1 - offset)
    df = approved.where((F.col("shares") > 0) & (F.col("stop") > 0))
    return df.withColumns({"take_profit": F.round(take, 2), "stop_price": F.round("stop", 2), "limit_price": F.round(limit, 2)})


def remaining_qty(orders: DataFrame, fills: DataFrame, key: str = "order_id") -> DataFrame:
    """Requested less whole filled quantity; nothing left means filled."""
    done = fills.groupBy(key).agg(F.sum("qty").alias("filled"))
    df = orders.join(done.hint("shuffle_hash"), key, "left")
    left = F.col("requested") - F.floor(F.coalesce("filled", F.lit(0.0)))
    return df.withColumn("remaining", F.greatest(left, F.lit(0.0))).withColumn("is_filled", left <= 0)


def breaker_bars(postures: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """The first bar of each path whose posture is not normal, and how many there are."""
    fired = postures.where("severity > 0")
    return fired.groupBy(*keys).agg(F.min(TS).alias("first_ts"), F.min_by("equity", TS).alias("equity"), F.min_by("severity", TS).alias("severity"), F.count("*").alias("bars"))


def stress_report(postures: DataFrame, paths: Sequence[str], keys: Sequence[str], blow_up: float = -0.25) -> DataFrame:
    """Losses over the paths of each probe. ``postures`` holds equity and severity."""
    by_path = [*keys, *paths]
    each = perf.with_drawdown(postures, by_path).groupBy(*by_path).agg(F.min("drawdown").alias("loss"), F.max("severity").alias("worst"))
    return each.groupBy(*keys).agg(
        F.count("*").alias("paths"),
        F.avg("loss").alias("mean_max_loss"),
        F.min("loss").alias("worst_max_loss"),
        F.avg((F.col("worst") > 0).cast("double")).alias("fired_rate"),
        F.avg((F.col("loss") <= blow_up).cast("double")).alias("blow_up_rate"),
    )


def random_paths(returns: DataFrame, seeds: int, draw: Column, slippage: float = 0.0005, capital: float = 100_000.0) -> DataFrame:
    """A path for each seed that holds the level drawn one bar earlier.

    ``draw`` gives 0 to 3 from ``seed`` and ``bar_no``. Levels are further apart
    than any rebalance threshold, so a draw is always followed.
    """
    numbered = returns.withColumn("bar_no", F.row_number().over(ordered()).cast("long"))
    wide = numbered.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds)).cast("array<bigint>")))
    keys = (SERIES, "seed")
    level = F.element_at(F.array(*[F.lit(v) for v in LEVELS]), draw.cast("int") + 1)
    df = wide.withColumn("weight", level)
    before = F.coalesce(F.lag("weight").over(ordered(keys)), F.lit(0.0))
    net = (1 + before * F.col("ret")) * (1 - F.abs(F.col("weight") - before) * slippage) - 1
    df = df.withColumn("net", net)
    return df.withColumn("equity", capital * F.product(1 + F.col("net")).over(running(keys)))


def random_allocation(paths: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Mean and population deviation of total return and Sharpe over the seeds."""
    each = paths.groupBy(SERIES, "seed").agg((F.max_by("equity", TS) / capital - 1).alias("total_return"), perf.sharpe(F.col("net")).alias("sharpe"))
    return each.groupBy(SERIES).agg(F.count("*").alias("seeds"), F.avg("total_return").alias("mean_return"), F.stddev_pop("total_return").alias("std_return"), F.avg("sharpe").alias("mean_sharpe"), F.stddev_pop("sharpe").alias("std_sharpe"))


def path_summary(paths: DataFrame, ret: str, capital: float, keys: Sequence[str]) -> DataFrame:
    """Total return, Sharpe and deepest drawdown of equity paths."""
    deep = perf.with_drawdown(paths, keys)
    return deep.groupBy(*keys).agg((F.max_by("equity", TS) / capital - 1).alias("total_return"), perf.sharpe(F.col(ret)).alias("sharpe"), F.min("drawdown").alias("max_drawdown"))


def with_parameters(signals: DataFrame, grid: Sequence[tuple[float, int]]) -> DataFrame:
    """Every signal once for each (floor, reentry) point of a small grid."""
    points = F.array(*[F.struct(F.lit(i).alias("point"), F.lit(f).alias("floor"), F.lit(k).alias("reentry")) for i, (f, k) in enumerate(grid)])
    return signals.withColumn("_p", F.explode(points)).select("*", "_p.*").drop("_p")


def best_point(scores: DataFrame, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """The point of the largest Sharpe; the first of the grid on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc("sharpe"), "point")
    return scores.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def alerts(changes: DataFrame, breakers: DataFrame, flickers: DataFrame, returns: DataFrame | None = None, gaps: DataFrame | None = None, decisions: DataFrame | None = None, outsized: float = 0.03) -> DataFrame:
    """Alert rows of regime changes, posture changes and flicker, and where given of
    outsized returns, silences of the feed and decisions on challengers, with severity."""
    row = lambda df, kind, level: df.select(SERIES, TS, (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), level.alias("level"))
    out = row(changes, "regime_change", F.lit("info"))
    out = out.unionByName(row(breakers, "posture_change", F.when(F.col("to_severity") == HALTED, "critical").otherwise("warning")))
    out = out.unionByName(row(flickers, "flicker", F.lit("warning")))
    if returns is not None:
        out = out.unionByName(row(returns.where(F.abs("ret") > outsized), "large_return", F.lit("warning")))
    if gaps is not None:
        out = out.unionByName(row(gaps, "feed_down", F.lit("critical")))
    if decisions is not None:
        out = out.unionByName(row(decisions, F.when(F.col("promoted"), "retrained").otherwise("retrain_rejected"), F.when(F.col("promoted"), "info").otherwise("warning")))
    return out


def benchmark_rows(benchmarks: dict[str, DataFrame], random: DataFrame) -> DataFrame:
    """A row for each benchmark curve and for the mean of random paths, which have
    neither growth rate nor drawdown."""
    out = random.select(SERIES, F.lit("random").alias("strategy"), F.col("mean_return").alias("total_return"), F.col("mean_sharpe").alias("sharpe"))
    for name, curve in benchmarks.items():
        out = out.unionByName(perf.benchmark_metrics(curve).withColumn("strategy", F.lit(name)), allowMissingColumns=True)
    return out


def benchmark_table(strategy: DataFrame, benchmarks: dict[str, DataFrame], random: DataFrame, capital: float) -> DataFrame:
    """A row for the strategy (against its capital), and those of its benchmarks."""
    own = perf.growth(strategy, capital, sharpe=perf.sharpe(F.col("net"))).drop("calmar").withColumn("strategy", F.lit("strategy"))
    return own.unionByName(benchmark_rows(benchmarks, random), allowMissingColumns=True)


# --- the decision log -------------------------------------------------------

#: What a decision was made on.
CONTEXT = {"regime": "int", "probability": "double", "equity": "double", "day_result": "double", "exposure": "double"}


def decision_lines(decisions: DataFrame) -> DataFrame:
    """(series_id, ts, event, line): each decision and its context as one line of JSON.
    Columns beside them go into the line as well."""
    inside = [c for c in decisions.columns if c not in (SERIES, TS, "event")]
    return decisions.select(SERIES, TS, "event", F.to_json(F.struct(*inside)).alias("line"))


def append_decisions(decisions: DataFrame, folder: str) -> None:
    """Append to the log, a folder for each day; nothing there is changed."""
    decision_lines(decisions).withColumn("day", F.to_date(TS)).write.mode("append").partitionBy("day").parquet(folder)


def recent_decisions(log: DataFrame, n: int = 20, since: str | None = None) -> DataFrame:
    """The last ``n`` of each series with their context; ``since`` (a day) reads only
    the days from it on. Of equal times the smaller line comes first."""
    if since is not None:
        log = log.where(F.col("day") >= F.lit(since).cast("date"))
    order = Window.partitionBy(SERIES).orderBy(F.desc(TS), "line")
    last = log.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return last.select(SERIES, TS, "event", F.from_json("line", ", ".join(f"{c} {t}" for c, t in CONTEXT.items())).alias("c")).select(SERIES, TS, "event", "c.*")
