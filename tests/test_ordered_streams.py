"""Folds in time order: late rows within the watermark change nothing, state goes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from barloom.operators import risk
from barloom.plans.report_queries import curve
from barloom.sources import bars as src
from barloom.streaming import jobs
from barloom.streaming.ordered import fold_in_order

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in map(dict, query.recentProgress) if p["stateOperators"]]
    query.stop()
    return stream.sparkSession.table(name).collect(), state


def shuffled(spark, rows, tmp_path, days, batches=4, end=None):
    """``rows`` as a stream whose times run up to ``days`` ahead of each other, and a
    last row of no key's that moves the watermark past all."""
    late = F.col("ts").cast("double") + F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(1000)) / 1000 * days * 86400
    low, high = (rows.select(f(late)).first()[0] for f in (F.min, F.max))
    part = F.least(F.floor((late - low) / ((high - low) / batches)), F.lit(batches - 1))
    for i in range(batches):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def closing(rows, key):
    """A row a year after the last one, of a key that no other has."""
    last = rows.orderBy(F.desc("ts")).limit(1)
    return last.withColumn(key, F.lit("end")).withColumn("ts", (F.col("ts") + F.expr("interval 400 days")).cast(dict(rows.dtypes)["ts"])).select(rows.columns)


def test_rate_limit(spark, sf_dir, tmp_path):
    rows = src.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("event_key"), "ts", F.col("event_id").cast("long").alias("alert_id"))
    want = {r.alert_id for r in risk.rate_limit(rows, 600.0).where("passed").collect()}
    stream = shuffled(spark, rows, tmp_path, 3, end=closing(rows, "event_key"))
    got, state = run(jobs.stream_rate_limit(stream, 600.0, "4 days"), tmp_path, "ordered_limit")
    kept = [r.alert_id for r in got if r.event_key != "end"]
    assert set(kept) == want and len(kept) == len(want) and want
    assert state[-1] <= 4 < max(state)  # the closing key's row and timer


def test_ledger(spark, sf_dir, tmp_path):
    rows = src.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", F.format_string("%012d", "event_id").alias("fill_id"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(2.0).alias("qty"), F.abs("value").alias("price"))
    want = {r.fill_id: (round(r.held, 6), round(r.avg_price, 6), round(r.realized, 6)) for r in risk.fill_ledger(rows).collect()}
    stream = shuffled(spark, rows, tmp_path, 3, end=closing(rows, "series_id"))
    got, _ = run(jobs.stream_ledger(stream, "4 days"), tmp_path, "ordered_ledger")
    assert {r.fill_id: (round(r.held, 6), round(r.avg_price, 6), round(r.realized, 6)) for r in got if r.series_id != "end"} == want


def test_breaker_and_idle_series(spark, sf_dir, tmp_path):
    rows = curve(spark, sf_dir).select("series_id", "ts", "ret", "equity").withColumn("ret", F.col("ret") * 3)
    want = {(r.series_id, r.ts): r.severity for r in risk.latched_breaker(rows).collect()}
    stream = shuffled(spark, rows, tmp_path, 20, end=closing(rows, "series_id"))
    got, state = run(jobs.stream_breaker(stream, "30 days", 100 * 86400), tmp_path, "ordered_breaker")
    assert {(r.series_id, r.ts): r.severity for r in got if r.series_id != "end"} == want
    assert state[-1] <= 4


def test_nulls_ties_and_rows_past_the_watermark(spark, tmp_path):
    """Counts a key's rows: a null key and null values, equal times by order, none twice."""

    def count(carried, rows):
        n = carried[0] if carried else 0
        return (n + len(rows),), rows[["us", "v"]].assign(n=range(n + 1, n + len(rows) + 1))

    schema = "k string, ts timestamp, v long"
    draw = random.Random(5)
    rows = [(k, 1000 + t, v) for k in ("a", None) for t in range(5) for v in (1, 2)] + [("a", None, 9), ("b", 1001, None)]
    draw.shuffle(rows)
    frame = lambda r: spark.createDataFrame(r, "k string, t long, v long").select("k", F.timestamp_seconds("t").alias("ts"), "v")
    for part in (rows, [("a", 1003, 3), ("c", 9000, 0)], [("a", 1002, 7), ("c", 9001, 0)], [("a", 1002, 8), ("c", 9002, 0)], [("c", 20000, 0)]):
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got, _ = run(fold_in_order(stream, ("k",), count, "n long", "us long, v long, n long", ("v",), "1 minute"), tmp_path, "ordered_count")
    by = lambda k: [(r.us // 1_000_000 - 1000, r.v) for r in sorted((r for r in got if r.k == k), key=lambda r: r.n)]
    whole = [(t, v) for t in range(5) for v in (1, 2)]
    assert by(None) == whole
    assert by("a") == sorted([*whole, (3, 3), (2, 7)])  # the row that came after the watermark had passed it is not there
    assert [(r.us, r.v) for r in got if r.k == "b"] == [(1001_000_000, None)]
