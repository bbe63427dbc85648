"""The full report of equity paths: the totals of each path and its breakdown tables.

One exchange by path serves all windows. Totals, regimes, confidence buckets and
segments between rebalances then come out of one grouping over sets of keys, whose
small result is folded into a row for each path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import TS, ordered, running, trailing
from barloom.operators.performance import BUCKETS, YEAR, K, sharpe, sortino

#: Measures of each section of the report, in order.
TOTALS = ("total_return", "cagr", "sharpe", "sortino", "calmar", "max_drawdown", "drawdown_duration", "total_trades", "win_rate", "avg_win", "avg_loss", "profit_factor", "avg_bars", "worst_bar", "worst_5", "worst_21", "loss_streak")
REGIME = ("bars", "share", "total_return", "mean_return", "win_rate", "sharpe")
CONFIDENCE = ("bars", "total_return", "sharpe")
BENCHMARK = ("total_return", "cagr", "sharpe", "max_drawdown")


def _marked(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a bar needs to know of the bars before it; all over one partitioning."""
    frame = running(keys)
    at = F.row_number().over(ordered(keys))
    since = lambda held: F.col("_n") - F.coalesce(F.max(F.when(~held, F.col("_n"))).over(frame), F.lit(0))
    span = lambda n: F.when(F.count("ret").over(trailing(n, keys)) == n, F.product(1 + F.col("ret")).over(trailing(n, keys)) - 1)
    trades = F.sum(F.coalesce(F.col("is_rebalance").cast("int"), F.lit(0))).over(frame)
    bucket = F.coalesce(*[F.when((F.col("confidence") >= lo) & (F.col("confidence") < hi), F.lit(label)) for label, lo, hi in BUCKETS])
    df = paths.withColumns({"_n": at, "_dd": F.col("equity") / F.max("equity").over(frame) - 1, "_5": span(5), "_21": span(21), "_trades": trades, "_open": F.lead(TS).over(ordered(keys)).isNotNull()})
    under, lost = F.coalesce(F.col("_dd") < 0, F.lit(False)), F.coalesce(F.col("ret") < 0, F.lit(False))
    return df.withColumns({"_under": since(under), "_lost": since(lost), "_segment": F.when((F.col("_trades") > 0) & F.col("_open"), F.col("_trades")), "_bucket": bucket})


def _ratio(top: Column, bottom: Column, otherwise: Column) -> Column:
    return F.when(bottom > 0, top / F.when(bottom > 0, bottom)).otherwise(otherwise)


def full_report(paths: DataFrame, capital: float, keys: Sequence[str] = K, rf: float = 0.0, benchmarks: DataFrame | None = None) -> DataFrame:
    """A row for each path: its totals, and ``regimes``, ``confidences`` and
    ``benchmarks`` as arrays of rows.

    ``paths`` has the keys, ts, ret (net), equity, is_rebalance, regime and
    confidence; other columns are ignored. Bars without a confidence, or with one
    outside all buckets, are in no bucket; buckets without bars are there with
    zeros. A null regime is a regime of its own, a null is_rebalance is none, a
    null return takes part in counts of bars only. A rebalance bar opens its
    segment; bars before the first and the last bar of all belong to none.
    ``benchmarks`` (keys, strategy and measures) may lack paths: their array is
    empty. No paths give no rows.
    """
    ret = F.col("ret")
    own = [F.col(k) for k in keys]
    held = paths.select(*keys, TS, "ret", "equity", "is_rebalance", "regime", "confidence")
    marked = _marked(held, keys)
    sets = [own, [*own, F.col("regime")], [*own, F.col("_bucket")], [*own, F.col("_segment")]]
    grouped = marked.groupingSets(sets, *own, "regime", "_bucket", "_segment").agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("bars"),
        (F.product(1 + ret) - 1).alias("grown"),
        F.avg("ret").alias("mean_return"),
        F.avg((ret > 0).cast("double")).alias("win_rate"),
        sharpe(ret, rf).alias("sharpe"),
        sortino(ret, rf).alias("sortino"),
        F.min_by("equity", TS).alias("first"),
        F.max_by("equity", TS).alias("last"),
        F.min("_dd").alias("max_drawdown"),
        F.max("_under").alias("drawdown_duration"),
        F.max("_trades").alias("total_trades"),
        F.min("ret").alias("worst_bar"),
        F.min("_5").alias("worst_5"),
        F.min("_21").alias("worst_21"),
        F.max("_lost").alias("loss_streak"),
    )
    whole, regime, bucket = F.col("_set") == 7, F.col("_set") == 3, (F.col("_set") == 5) & F.col("_bucket").isNotNull()
    segment = (F.col("_set") == 6) & F.col("_segment").isNotNull()
    grown = F.col("grown")
    won, lost = F.when(segment & (grown > 0), grown), F.when(segment & (grown < 0), grown)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    one = ("bars", "first", "last", "sharpe", "sortino", "max_drawdown", "drawdown_duration", "total_trades", "worst_bar", "worst_5", "worst_21", "loss_streak")
    folded = grouped.groupBy(*keys).agg(
        F.max(F.when(whole, F.struct(*one))).alias("_t"),
        F.avg(F.when(segment, (grown > 0).cast("double"))).alias("_wins"),
        F.avg(won).alias("_aw"),
        F.avg(lost).alias("_al"),
        F.sum(won).alias("_sw"),
        F.sum(-lost).alias("_sl"),
        F.avg(F.when(segment, F.col("bars"))).alias("_ab"),
        F.sort_array(F.collect_list(F.when(regime, F.struct("regime", "bars", F.col("grown").alias("total_return"), "mean_return", "win_rate", "sharpe")))).alias("_regimes"),
        F.map_from_entries(F.collect_list(F.when(bucket, F.struct("_bucket", F.struct("bars", "grown", "sharpe"))))).alias("_buckets"),
    )
    t = lambda c: F.col(f"_t.{c}")
    cagr = F.when((t("bars") < 2) | (t("first") <= 0), 0.0).otherwise(F.pow(t("last") / F.when(t("first") > 0, t("first")), F.lit(float(YEAR)) / t("bars")) - 1)
    infinite = F.when(zero(F.col("_sw")) > 0, F.lit(float("inf"))).otherwise(0.0)
    totals = {
        **{c: t(c) for c in one if c in TOTALS},
        "total_return": t("last") / capital - 1,
        "cagr": cagr,
        "calmar": _ratio(cagr, -t("max_drawdown"), F.lit(0.0)),
        "win_rate": zero(F.col("_wins")),
        "avg_win": zero(F.col("_aw")),
        "avg_loss": zero(F.col("_al")),
        "profit_factor": _ratio(zero(F.col("_sw")), F.col("_sl"), infinite),
        "avg_bars": zero(F.col("_ab")),
    }
    regimes = F.transform("_regimes", lambda r: F.struct(r["regime"].alias("regime"), r["bars"].alias("bars"), (r["bars"] / t("bars")).alias("share"), *[r[c].alias(c) for c in REGIME[2:]]))

    def in_bucket(label: str) -> Column:
        found = F.try_element_at("_buckets", F.lit(label))
        return F.struct(F.lit(label).alias("bucket"), F.coalesce(found["bars"], F.lit(0).cast("long")).alias("bars"), zero(found["grown"]).alias("total_return"), zero(found["sharpe"]).alias("sharpe"))

    out = folded.select(*keys, *[totals[c].alias(c) for c in TOTALS], regimes.alias("regimes"), F.array(*[in_bucket(b[0]) for b in BUCKETS]).alias("confidences"))
    if benchmarks is None:
        return out
    beside = benchmarks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("strategy", *BENCHMARK))).alias("_b"))
    none = F.expr("CAST(array() AS array<struct<strategy: string, " + ", ".join(f"{c}: double" for c in BENCHMARK) + ">>)")
    return out.join(beside.hint("shuffle_hash"), list(keys), "left").withColumn("benchmarks", F.coalesce("_b", none)).drop("_b")


def report_lines(report: DataFrame, keys: Sequence[str] = K) -> DataFrame:
    """(keys, section, item, measure, value): a report as one long table, as for export."""

    def line(section: str, item: Column, measure: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), F.lit(measure).alias("measure"), value.cast("double").alias("value"))

    def table(column: str, section: str, item: str, measures: Sequence[str]) -> Column:
        return F.flatten(F.transform(column, lambda r: F.array(*[line(section, r[item], m, r[m]) for m in measures])))

    parts = [F.array(*[line("total", F.lit("all"), m, F.col(m)) for m in TOTALS]), table("regimes", "regime", "regime", REGIME), table("confidences", "confidence", "bucket", CONFIDENCE)]
    if "benchmarks" in report.columns:
        parts.append(table("benchmarks", "benchmark", "strategy", BENCHMARK))
    return report.select(*keys, F.inline(F.concat(*parts)))
