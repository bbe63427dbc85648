"""Performance of return and equity paths, for any number of groups at once.

``keys`` name the groups: series, fold, scenario, regime. Inputs are
(keys, ts, ret) or (keys, ts, equity); one row of numbers per group comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import SERIES, TS, ordered, running, trailing

YEAR = 252
K = (SERIES,)

#: Named crisis spans, both ends included. Fixed values.
CRISES = {
    "gfc_2008": ("2007-10-01", "2009-06-30"),
    "euro_2011": ("2011-07-01", "2011-12-31"),
    "china_2015": ("2015-08-01", "2016-02-29"),
    "q4_2018": ("2018-10-01", "2018-12-31"),
    "covid_2020": ("2020-02-15", "2020-04-30"),
    "bear_2022": ("2022-01-01", "2022-10-31"),
    "full": ("1900-01-01", "2999-12-31"),
}


def sharpe(ret: Column, rf: float = 0.0) -> Column:
    spread = F.stddev_pop(ret)
    return F.when(spread > 0, (F.avg(ret) - rf / YEAR) / spread * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


def sortino(ret: Column, rf: float = 0.0) -> Column:
    down = F.sqrt(F.avg(F.when(ret < 0, ret * ret)))
    return F.when(down > 0, (F.avg(ret) - rf / YEAR) / down * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


def ratios(returns: DataFrame, keys: Sequence[str] = K, rf: float = 0.0) -> DataFrame:
    return returns.groupBy(*keys).agg(sharpe(F.col("ret"), rf).alias("sharpe"), sortino(F.col("ret"), rf).alias("sortino"))


def with_drawdown(equity: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    return equity.withColumn("drawdown", F.col("equity") / F.max("equity").over(running(keys)) - 1)


def max_drawdown(equity: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    return with_drawdown(equity, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def longest_run(df: DataFrame, condition: Column, keys: Sequence[str] = K, out: str = "longest") -> DataFrame:
    """Longest stretch of consecutive rows for which the condition holds."""
    df = df.withColumn("_in", F.coalesce(condition, F.lit(False)))
    df = df.withColumn("_island", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(running(keys)))
    runs = df.groupBy(*keys, "_island").agg(F.count_if("_in").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias(out))


def drawdown_duration(equity: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    return longest_run(with_drawdown(equity, keys), F.col("drawdown") < 0, keys, "drawdown_duration")


def growth(equity: DataFrame, capital: float, keys: Sequence[str] = K, **more: Column) -> DataFrame:
    """cagr, calmar, total return and deepest drawdown of an equity path, and any
    ``more`` aggregates of its rows, in one grouping."""
    out = with_drawdown(equity, keys).groupBy(*keys).agg(F.min_by("equity", TS).alias("first"), F.max_by("equity", TS).alias("last"), F.count("*").alias("n"), F.min("drawdown").alias("max_drawdown"), *[c.alias(name) for name, c in more.items()])
    cagr = F.when((F.col("n") < 2) | (F.col("first") <= 0), 0.0).otherwise(F.pow(F.col("last") / F.when(F.col("first") > 0, F.col("first")), F.lit(float(YEAR)) / F.col("n")) - 1)
    out = out.withColumn("cagr", cagr)
    calmar = F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs(F.when(F.col("max_drawdown") < 0, F.col("max_drawdown")))).otherwise(0.0)
    return out.select(*keys, "cagr", calmar.alias("calmar"), (F.col("last") / capital - 1).alias("total_return"), "max_drawdown", *more)


def regime_breakdown(returns: DataFrame, regime: str = "regime", keys: Sequence[str] = K) -> DataFrame:
    out = returns.groupBy(*keys, regime).agg(F.count("*").alias("bars"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), F.avg("ret").alias("mean_return"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), sharpe(F.col("ret")).alias("sharpe"))
    return out.withColumn("share", F.col("bars") / F.sum("bars").over(Window.partitionBy(*keys)))


#: Confidence buckets: label, from, to. Fixed values.
BUCKETS = (("<50%", 0.0, 0.5), ("50-60%", 0.5, 0.6), ("60-70%", 0.6, 0.7), ("70%+", 0.7, 1.0001))


def confidence_breakdown(returns: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """By confidence bucket; buckets without bars are there with zeros."""
    bucket = F.coalesce(*[F.when((F.col("confidence") >= lo) & (F.col("confidence") < hi), F.lit(label)) for label, lo, hi in BUCKETS])
    found = returns.withColumn("bucket", bucket).where("bucket is not null").groupBy(*keys, "bucket").agg(F.count("*").alias("bars"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), sharpe(F.col("ret")).alias("sharpe"))
    every = returns.select(*keys).distinct().withColumn("bucket", F.explode(F.array(*[F.lit(b[0]) for b in BUCKETS])))
    joined = every.join(found.hint("shuffle_hash"), [*keys, "bucket"], "left")
    return joined.select(*keys, "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bars", "total_return", "sharpe")])


def segments(returns: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Bars between rebalances, compounded. A rebalance bar opens its segment; bars
    before the first one and the last bar of all belong to none."""
    df = returns.withColumn("_seg", F.sum(F.col("is_rebalance").cast("int")).over(running(keys)))
    df = df.withColumn("_last", F.lead(TS).over(ordered(keys)).isNull()).where((F.col("_seg") > 0) & ~F.col("_last"))
    return df.groupBy(*keys, F.col("_seg").alias("segment")).agg(F.min(TS).alias("start_ts"), F.count("*").alias("bars"), (F.product(1 + F.col("ret")) - 1).alias("ret"))


def trade_stats(returns: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    parts = segments(returns, keys).groupBy(*keys).agg(F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("avg_win"), F.avg(F.when(F.col("ret") < 0, F.col("ret"))).alias("avg_loss"), F.sum(F.when(F.col("ret") > 0, F.col("ret"))).alias("_won"), F.sum(F.when(F.col("ret") < 0, -F.col("ret"))).alias("_lost"), F.avg("bars").alias("avg_bars"))
    total = returns.groupBy(*keys).agg(F.sum(F.col("is_rebalance").cast("int")).alias("total_trades"))
    factor = F.when(F.coalesce("_lost", F.lit(0.0)) > 0, F.coalesce("_won", F.lit(0.0)) / F.when(F.col("_lost") > 0, F.col("_lost"))).when(F.coalesce("_won", F.lit(0.0)) > 0, F.lit(float("inf"))).otherwise(0.0)
    return total.join(parts.hint("shuffle_hash"), list(keys), "left").select(*keys, "total_trades", F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"), F.coalesce("avg_win", F.lit(0.0)).alias("avg_win"), F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"), factor.alias("profit_factor"), F.coalesce("avg_bars", F.lit(0.0)).alias("avg_bars"))


def worst_case(returns: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Worst bar, worst full 5- and 21-bar spans, longest losing streak, and the
    longest stretch of the compounded path under its peak."""
    span = lambda n: F.when(F.count("ret").over(trailing(n, keys)) == n, F.product(1 + F.col("ret")).over(trailing(n, keys)) - 1)
    worst = returns.withColumns({"_5": span(5), "_21": span(21)}).groupBy(*keys).agg(F.min("ret").alias("worst_bar"), F.min("_5").alias("worst_5"), F.min("_21").alias("worst_21"))
    streak = longest_run(returns, F.col("ret") < 0, keys, "loss_streak")
    under = drawdown_duration(buy_hold(returns, 1.0, keys), keys).withColumnRenamed("drawdown_duration", "underwater")
    return worst.join(streak.hint("shuffle_hash"), list(keys)).join(under.hint("shuffle_hash"), list(keys))


def buy_hold(returns: DataFrame, capital: float, keys: Sequence[str] = K) -> DataFrame:
    return returns.withColumn("equity", capital * F.product(1 + F.col("ret")).over(running(keys)))


def trend_weights(bars: DataFrame, rows: int = 200) -> DataFrame:
    """1 while the bar before closed above its moving average, else 0."""
    frame = trailing(rows)
    above = F.when(F.count("close").over(frame) == rows, (F.col("close") > F.avg("close").over(frame)).cast("double")).otherwise(0.0)
    return bars.withColumn("_above", above).withColumn("weight", F.coalesce(F.lag("_above").over(ordered()), F.lit(0.0))).drop("_above")


def in_slices(rows: DataFrame, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows inside named spans, both ends included; a row may stand in several.
    Only the spans, a table of the caller's, are broadcast."""
    table = rows.sparkSession.createDataFrame([(n, a, b) for n, (a, b) in spans.items()], "slice string, lo string, hi string")
    table = table.select("slice", F.to_timestamp("lo").alias("lo"), F.to_timestamp("hi").alias("hi"))
    return rows.join(F.broadcast(table), (F.col(TS) >= F.col("lo")) & (F.col(TS) <= F.col("hi"))).drop("lo", "hi")


def crisis_slices(returns: DataFrame, spans: dict[str, tuple[str, str]] = CRISES, keys: Sequence[str] = K) -> DataFrame:
    """Metrics inside named spans, compounded from each span's own start. Spans
    with fewer than two bars are left out."""
    own = [*keys, "slice"]
    path = in_slices(returns, spans).withColumn("equity", F.product(1 + F.col("ret")).over(running(own)))
    path = path.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(running(own)), F.lit(1.0)) - 1)
    return path.groupBy(*own).agg(F.count("*").alias("bars"), (F.max_by("equity", TS) - 1).alias("total_return"), sharpe(F.col("ret")).alias("sharpe"), F.min("drawdown").alias("max_drawdown")).where("bars >= 2")


def slice_report(paths: DataFrame, spans: dict[str, tuple[str, str]] = CRISES, keys: Sequence[str] = K, rf: float = 0.0) -> DataFrame:
    """A strategy beside holding and the trend rule inside named spans.

    A row of ``paths`` has net (the strategy's return), ret (the asset's), trend_ret
    (the trend rule's, its average taken over the whole series) and severity.
    Drawdowns begin anew in each span; spans with fewer than two bars are left out.
    """
    own = [*keys, "slice"]
    frame = running(own)
    df = in_slices(paths, spans).withColumns({"_e": F.product(1 + F.col("net")).over(frame), "_h": F.product(1 + F.col("ret")).over(frame)})
    df = df.withColumns({"_ed": F.col("_e") / F.max("_e").over(frame) - 1, "_hd": F.col("_h") / F.max("_h").over(frame) - 1})
    return df.groupBy(*own).agg(
        F.count("*").alias("bars"),
        (F.max_by("_e", TS) - 1).alias("total_return"),
        sharpe(F.col("net"), rf).alias("sharpe"),
        F.min("_ed").alias("max_drawdown"),
        (F.max_by("_h", TS) - 1).alias("hold_return"),
        sharpe(F.col("ret"), rf).alias("hold_sharpe"),
        F.min("_hd").alias("hold_drawdown"),
        (F.product(1 + F.col("trend_ret")) - 1).alias("trend_return"),
        F.avg((F.col("severity") == 2).cast("double")).alias("halted_share"),
    ).where("bars >= 2")


def holdout_gate(slices: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """In how many of its slices a strategy has a larger Sharpe and a shallower drawdown than holding."""
    won = (F.col("sharpe") > F.col("hold_sharpe")) & (F.col("max_drawdown") > F.col("hold_drawdown"))
    return slices.groupBy(*keys).agg(F.count_if(won).alias("passes"), F.count("*").alias("slices"))


def benchmark_metrics(paths: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """Metrics of benchmark curves from their own first value: the first bar has no
    return. Curves of one bar have zeros."""
    df = with_drawdown(paths.withColumn("_r", F.try_divide("equity", F.lag("equity").over(ordered(keys))) - 1), keys)
    growth_of = F.try_divide(F.max_by("equity", TS), F.min_by("equity", TS))
    many = F.count("equity") >= 2
    zero = lambda c: F.when(many, c).otherwise(0.0)
    return df.groupBy(*keys).agg(zero(growth_of - 1).alias("total_return"), zero(F.pow(growth_of, F.lit(float(YEAR)) / F.count("equity")) - 1).alias("cagr"), zero(sharpe(F.col("_r"))).alias("sharpe"), zero(F.min("drawdown")).alias("max_drawdown"))


def beats(own: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether a strategy beats a benchmark: by return, and by risk-adjusted return."""
    b = other.select(*keys, F.col("total_return").alias("b_return"), F.col("sharpe").alias("b_sharpe"), F.col("max_drawdown").alias("b_drawdown"))
    joined = own.join(b.hint("shuffle_hash"), list(keys))
    return joined.withColumn("beats_raw", F.col("total_return") > F.col("b_return")).withColumn("beats_risk_adjusted", (F.col("sharpe") > F.col("b_sharpe")) & (F.col("max_drawdown") > F.col("b_drawdown"))).drop("b_return", "b_sharpe", "b_drawdown")
