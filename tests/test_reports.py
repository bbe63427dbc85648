"""The full report against the single operators, and on odd paths."""

import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import performance as perf
from barloom.operators import reports
from barloom.plans import state_queries as sq

COLUMNS = "series_id string, ts timestamp, ret double, equity double, is_rebalance boolean, regime int, confidence double, bars string, _n string"


def near(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def test_equals_single_operators(spark, sf_dir):
    paths = sq.reported(spark, sf_dir).cache()
    got = {r.series_id: r for r in reports.full_report(paths, 100_000.0).collect()}
    parts = [perf.growth(paths, 100_000.0), perf.ratios(paths), perf.drawdown_duration(paths), perf.trade_stats(paths), perf.worst_case(paths).drop("underwater")]
    for part in parts:
        for r in part.collect():
            assert all(near(got[r.series_id][c], r[c]) for c in part.columns), (part.columns, r)
    regimes = {(r.series_id, r.regime): r for r in perf.regime_breakdown(paths).collect()}
    mine = {(k, x.regime): x for k, r in got.items() for x in r.regimes}
    assert mine.keys() == regimes.keys() and all(near(mine[k][c], regimes[k][c]) for k in mine for c in reports.REGIME)
    buckets = {(r.series_id, r.bucket): r for r in perf.confidence_breakdown(paths).collect()}
    mine = {(k, x.bucket): x for k, r in got.items() for x in r.confidences}
    assert mine.keys() == buckets.keys() and all(near(mine[k][c], buckets[k][c]) for k in mine for c in reports.CONFIDENCE)
    paths.unpersist()


def day(n):
    import datetime

    return datetime.datetime(2020, 1, n)


def test_odd_paths(spark):
    rows = [
        ("one", day(1), 0.0, 100.0, False, 1, 0.55, "x", "y"),
        ("null", day(1), None, 100.0, None, None, None, None, None),
        ("null", day(2), -0.5, 50.0, True, None, 5.0, None, None),
        ("null", day(3), -0.1, 45.0, False, 2, 0.7, None, None),
        ("null", day(4), 0.2, 54.0, False, 2, 0.5, None, None),
        (None, day(1), 0.1, 110.0, False, 1, 0.1, "x", "y"),
    ]
    got = {r.series_id: r for r in reports.full_report(spark.createDataFrame(rows, COLUMNS), 100.0).collect()}
    assert set(got) == {"one", "null", None}
    one, odd = got["one"], got["null"]
    assert (one.cagr, one.calmar, one.sharpe, one.profit_factor, one.total_trades, one.avg_bars, one.worst_5) == (0, 0, 0, 0, 0, 0, None)
    assert (odd.drawdown_duration, odd.loss_streak, odd.total_trades, odd.avg_bars) == (3, 2, 1, 2)  # days 2 and 3 are the segment
    assert odd.avg_loss == pytest.approx(0.5 * 0.9 - 1) and odd.profit_factor == 0 and odd.total_return == pytest.approx(-0.46)
    assert [(r.regime, r.bars, r.share) for r in odd.regimes] == [(None, 2, 0.5), (2, 2, 0.5)]
    assert [(r.bucket, r.bars) for r in odd.confidences] == [("<50%", 0), ("50-60%", 1), ("60-70%", 0), ("70%+", 1)]


def test_empty_and_missing_benchmarks(spark):
    paths = spark.createDataFrame([], COLUMNS)
    assert reports.report_lines(reports.full_report(paths, 1.0)).count() == 0
    some = spark.createDataFrame([("a", day(1), 0.1, 1.1, True, 0, 0.9, "", "")], COLUMNS)
    beside = spark.createDataFrame([("b", "hold", 0.0, 0.0, 0.0, 0.0)], "series_id string, strategy string, total_return double, cagr double, sharpe double, max_drawdown double")
    row = reports.full_report(some, 1.0, benchmarks=beside).first()
    assert row.benchmarks == [] and row.series_id == "a"
    assert reports.report_lines(reports.full_report(some, 1.0, benchmarks=beside)).count() == len(reports.TOTALS) + len(reports.REGIME) + 4 * len(reports.CONFIDENCE)


def test_one_exchange_for_all_windows(spark, sf_dir):
    plan = reports.full_report(sq.reported(spark, sf_dir).repartition(4).cache(), 1.0)._jdf.queryExecution().executedPlan().toString()
    own = plan.split("InMemoryTableScan")[0]
    assert own.count("Exchange hashpartitioning") <= 3
    spark.catalog.clearCache()


def test_several_keys(spark, sf_dir):
    paths = sq.reported(spark, sf_dir).withColumn("fold", F.explode(F.array(F.lit(1), F.lit(2))))
    got = reports.full_report(paths, 100_000.0, ("series_id", "fold"))
    assert got.count() == 2 * got.select("series_id").distinct().count()
