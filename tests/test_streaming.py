"""Batch and stream give the same rows."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import regimes as reg
from barloom.operators import risk
from barloom.plans.report_queries import curve
from barloom.sources import bars as src
from barloom.streaming import jobs, regime_jobs
from barloom.streaming.latest import LatestSink


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def spans(spark, rows, tmp_path, per_batch=1):
    """``rows`` as a stream: three spans of time, one after the other, a batch for each."""
    low, high = (r[0].timestamp() for r in rows.select(F.min("ts")).union(rows.select(F.max("ts"))).collect())
    part = F.least(F.floor((F.col("ts").cast("double") - low) / ((high - low) / 3)), F.lit(2))
    for i in range(3):  # written in turn, so that the file source takes them in order
        rows.where(part == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{tmp_path}/in")


def events(spark, sf_dir, tmp_path, per_batch=1):
    rows = src.read_table(spark, sf_dir, "events")
    return rows, spans(spark, rows, tmp_path, per_batch)


def test_rate_limit(spark, sf_dir, tmp_path):
    batch, stream = events(spark, sf_dir, tmp_path)
    shape = lambda df: df.select(F.col("event_type").alias("event_key"), "ts", F.col("event_id").alias("alert_id"))
    want = {r.alert_id for r in risk.rate_limit(shape(batch)).where("passed").collect()}
    got = {r.alert_id for r in run(jobs.stream_rate_limit(shape(stream)), tmp_path, "limited").collect()}
    assert got == want and want


def test_bars(spark, sf_dir, tmp_path):
    batch, stream = events(spark, sf_dir, tmp_path)
    shape = lambda df: df.select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.struct("ts", "event_id").alias("seq"))
    want = {(r.series_id, r.ts): tuple(r)[2:] for r in src.resample_bars(shape(batch), "1h").collect()}
    got = {(r.series_id, r.ts): tuple(r)[2:] for r in run(jobs.stream_bars(shape(stream), "1h", "1 hour"), tmp_path, "hours").collect()}
    late = max(t for _, t in want)  # hours past the last watermark are still open
    assert all(want[k] == v for k, v in got.items())
    assert {k for k in want if (late - k[1]).total_seconds() > 3 * 3600} <= got.keys() and got


def test_ledger(spark, sf_dir, tmp_path):
    batch, stream = events(spark, sf_dir, tmp_path)
    shape = lambda df: df.select(F.col("event_type").alias("series_id"), "ts", F.format_string("%012d", "event_id").alias("fill_id"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(2.0).alias("qty"), F.abs("value").alias("price"))
    want = {r.fill_id: (round(r.held, 6), round(r.avg_price, 6)) for r in risk.fill_ledger(shape(batch)).collect()}
    got = {r.fill_id: (round(r.held, 6), round(r.avg_price, 6)) for r in run(jobs.stream_ledger(shape(stream)), tmp_path, "ledger").collect()}
    assert got == want


def bars(spark, sf_dir, tmp_path):
    """An equity curve and its stream."""
    rows = curve(spark, sf_dir).select("series_id", "ts", "close", "ret", "equity").withColumn("ret", F.col("ret") * 3)
    return rows, spans(spark, rows, tmp_path)


def test_breaker(spark, sf_dir, tmp_path):
    batch, stream = bars(spark, sf_dir, tmp_path)
    want = {(r.series_id, r.ts): r.severity for r in risk.latched_breaker(batch).collect()}
    got = {(r.series_id, r.ts): r.severity for r in run(jobs.stream_breaker(stream), tmp_path, "breaker").collect()}
    assert got == want and set(want.values()) >= {0, 2}


def test_rolling_mean(spark, sf_dir, tmp_path):
    batch, stream = bars(spark, sf_dir, tmp_path)
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(-49, 0)
    want = {(r.series_id, r.ts): (r.n, r.m) for r in batch.select("series_id", "ts", F.count("close").over(w).alias("n"), F.avg("close").over(w).alias("m")).collect()}
    got = {(r.series_id, r.ts): (r.bars, r.mean) for r in run(jobs.stream_rolling_mean(stream, 50), tmp_path, "rolling").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and got[k][1] == pytest.approx(m, rel=1e-9) for k, (n, m) in want.items())


def test_staleness(spark, sf_dir, tmp_path):
    batch, stream = events(spark, sf_dir, tmp_path, 5)
    shape = lambda df: df.select(F.col("event_type").alias("series_id"), "ts")
    gap = F.col("ts").cast("double") - F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts")).cast("double")
    want = sorted((r.series_id, r.ts) for r in shape(batch).withColumn("gap", gap).where("gap > 300").collect())
    keys = shape(batch).select("series_id").distinct().count()
    query = jobs.stream_staleness(shape(stream), timer_ms=500).writeStream.format("memory").queryName("stale").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        for _ in range(60):
            got = spark.table("stale").collect()
            if sum(r.kind == "stale" for r in got) >= keys:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert sorted((r.series_id, r.ts) for r in got if r.kind == "gap") == want and want
    assert {r.series_id for r in got if r.kind == "stale"} == {r.series_id for r in shape(batch).distinct().collect()}


def test_dedupe(spark, sf_dir, tmp_path):
    batch, stream = events(spark, sf_dir, tmp_path)
    keys = ("user_id", "event_type")
    shape = lambda df: df.select(*keys, "ts", F.col("event_id").cast("long").alias("order_id"))
    want = {r.order_id: r.is_duplicate for r in risk.duplicate_veto(shape(batch), keys, 86_400).collect()}
    got = {r.order_id: r.is_duplicate for r in run(regime_jobs.stream_dedupe(shape(stream), keys, 86_400), tmp_path, "dedupe").collect()}
    assert got == want and set(want.values()) == {True, False}


def regimes(spark, rows, tmp_path):
    """Models of the batch, and its states: what the stream must give."""
    features = rows.withColumn("vol", F.stddev_samp("ret").over(Window.partitionBy("series_id").orderBy("ts").rowsBetween(-19, 0))).na.drop()
    reg.fit_regime_models(features, ("ret", "vol"), 3).write.parquet(f"{tmp_path}/models")
    models = spark.read.parquet(f"{tmp_path}/models")
    scored = reg.with_flicker(reg.with_runs(reg.regime_proba(features, models, ("ret", "vol"))))
    return models, {(r.series_id, r.ts): (r.state_id, r.consecutive_bars, r.is_confirmed, r.flicker, r.probability) for r in scored.collect()}


def same(got, want):
    assert got.keys() == want.keys() and want
    for k, v in want.items():
        assert got[k][:4] == v[:4] and got[k][4] == pytest.approx(v[4], rel=1e-6)


def test_regimes_from_cold(spark, sf_dir, tmp_path):
    batch, stream = bars(spark, sf_dir, tmp_path)
    models, want = regimes(spark, batch, tmp_path)
    rows = run(regime_jobs.stream_regimes(stream, models), tmp_path, "cold").collect()
    assert len(rows) == batch.count()
    same({(r.series_id, r.ts): (r.state_id, r.consecutive_bars, r.is_confirmed, r.flicker, r.probability) for r in rows if r.state_id is not None}, want)


def test_regimes_from_history(spark, sf_dir, tmp_path):
    batch = curve(spark, sf_dir).select("series_id", "ts", "ret").withColumn("ret", F.col("ret") * 3)
    models, want = regimes(spark, batch, tmp_path)
    cut = sorted({t for _, t in want})[len(want) // 6]
    regime_jobs.warm_start(batch.where(F.col("ts") < cut), models).write.parquet(f"{tmp_path}/warm")
    stream = spans(spark, batch.where(F.col("ts") >= cut), tmp_path)
    rows = run(regime_jobs.stream_regimes(stream, models, spark.read.parquet(f"{tmp_path}/warm")), tmp_path, "warm").collect()
    same({(r.series_id, r.ts): (r.state_id, r.consecutive_bars, r.is_confirmed, r.flicker, r.probability) for r in rows}, {k: v for k, v in want.items() if k[1] >= cut})


def test_spread_filter(spark):
    rows = spark.createDataFrame([("a", 1, 100.0, 100.1), ("a", 3, 100.0, 103.0), ("b", 2, 50.0, 50.1), ("a", 2, 99.0, 99.1)], "series_id string, t int, bid double, ask double").withColumn("ts", F.timestamp_seconds("t"))
    kept = jobs.stream_spread_filter(rows)
    assert {(r.series_id, r.t) for r in kept.collect()} == {("a", 1), ("b", 2), ("a", 2)}


def test_latest_rows_survive_restarts(spark, tmp_path):
    """Repeated, missing and late batches, a new checkpoint, unfinished writes and merges."""
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("b", 2, 3.0), (None, 4, 4.0), ("a", 3, 5.0), ("c", None, 6.0)], "series_id string, t int, v double").withColumn("ts", F.timestamp_seconds("t"))
    sink = LatestSink(f"{tmp_path}/latest", run="first", merge_every=3)
    assert sink.read(spark) is None
    got = lambda: {(r.series_id, r.t) for r in sink.read(spark).collect()}
    parts = lambda: sorted(p.name for p in (tmp_path / "latest").iterdir())
    sink(rows.where("series_id = 'b'"), 0)
    sink(rows.where("v = 2"), 1)
    before = sink.read(spark).collect()
    sink(rows.where("v = 2"), 1)  # a batch that runs again
    assert sink.read(spark).collect() == before and got() == {("b", 2), ("a", 3)}
    sink(rows.where("v = 1 or series_id is null"), 4)  # ids need not follow each other; an older row does not win
    assert got() == {("b", 2), ("a", 3), (None, 4)}
    sink(rows.where("series_id = 'c'"), 5)
    assert parts() == ["base-0"] and got() == {("b", 2), ("a", 3), (None, 4), ("c", None)}
    sink(rows.where("v = 2"), 1)  # again, after it was merged
    LatestSink(f"{tmp_path}/latest", run="second", merge_every=3)(rows.where("v = 5"), 0)  # a new checkpoint counts anew
    (tmp_path / "latest" / "base-7").mkdir()  # a merge that did not finish
    chosen = {r.v for r in sink.read(spark).where("series_id = 'a'").collect()}
    assert len(chosen) == 1 and chosen <= {2.0, 5.0}
    sink.merge(spark)
    assert parts() == ["base-1", "base-7"] and {r.v for r in sink.read(spark).where("series_id = 'a'").collect()} == chosen
    sink.merge(spark)  # nothing to do
    assert parts() == ["base-1", "base-7"]


def test_latest_rows_of_a_stream(spark, sf_dir, tmp_path):
    batch, stream = events(spark, sf_dir, tmp_path)
    shape = lambda df: df.select(F.col("event_type").alias("series_id"), "ts", "event_id")
    sink = LatestSink(f"{tmp_path}/latest", merge_every=2)
    query = shape(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    want = {(r.series_id, r.ts) for r in shape(batch).groupBy("series_id").agg(F.max("ts").alias("ts")).collect()}
    assert {(r.series_id, r.ts) for r in sink.read(spark).collect()} == want
