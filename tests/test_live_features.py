"""Features and regimes of a bar stream equal those of the batch; idle state goes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import regimes as reg
from barloom.sources import bars as src
from barloom.streaming import live_features as live

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


@pytest.fixture(scope="module")
def stored_bars(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("live") / "bars")
    src.daily_bars(spark, sf_dir).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="module")
def scored(spark, stored_bars, tmp_path_factory):
    """Batch features, and states of series A and N under a model of two states."""
    features = ind.standardised_features(stored_bars)
    wide, one = [[1.5 if i == j else 0.2 if abs(i - j) == 1 else 0.0 for j in range(14)] for i in range(14)], [0.3] * 14
    models = spark.createDataFrame([(k, [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [one, [-x for x in one]], [wide, wide]) for k in ("A", "N")], f"series_id string, {live.MODEL}")
    folder = str(tmp_path_factory.mktemp("live") / "scored")
    reg.with_flicker(reg.with_runs(reg.regime_proba(features, models, ind.FEATURES))).write.parquet(f"{folder}/states")
    features.write.parquet(f"{folder}/features")
    return models, {(r.series_id, r.ts): r for r in spark.read.parquet(f"{folder}/features").collect()}, {(r.series_id, r.ts): r for r in spark.read.parquet(f"{folder}/states").collect()}


def stream_of(spark, rows, tmp_path, cuts):
    for low, high in zip(cuts, cuts[1:]):
        rows.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name).collect()


def same(rows, features, states):
    whole = {(r.series_id, r.ts): r for r in rows if not any(r[c] is None or np.isnan(r[c]) for c in ind.FEATURES)}
    assert whole.keys() == features.keys() and whole
    for key, want in features.items():
        assert np.allclose([whole[key][c] for c in ind.FEATURES], [want[c] for c in ind.FEATURES], rtol=1e-6, atol=1e-6), key
        if key in states:
            got, state = whole[key], states[key]
            assert (got.state_id, got.consecutive_bars, got.is_confirmed, got.flicker) == (state.state_id, state.consecutive_bars, state.is_confirmed, state.flicker)
            assert got.probability == pytest.approx(state.probability, rel=1e-6)
        else:
            assert whole[key].state_id is None


def test_stream_with_history(spark, rocks, stored_bars, scored, tmp_path):
    """Begins from history (a model for A and N, none for R) and goes on in three batches."""
    models, features, states = scored
    cut = "1995-03-01"
    live.warm_state(stored_bars.where(F.col("ts") < cut), models).write.parquet(f"{tmp_path}/warm")
    stream = stream_of(spark, stored_bars, tmp_path, [cut, "1996-01-01", "1996-01-03", "2030-01-01"])
    rows = run(live.stream_features(stream, spark.read.parquet(f"{tmp_path}/warm")), tmp_path, "live_warm")
    late = lambda d: {k: v for k, v in d.items() if str(k[1]) >= cut}
    assert len(rows) == stored_bars.where(F.col("ts") >= cut).count()
    same(rows, late(features), late(states))


def test_stream_from_cold_and_repeated_bars(spark, rocks, stored_bars, scored, tmp_path):
    _, features, _ = scored
    some = stored_bars.where("series_id = 'R'")
    stream = stream_of(spark, some.union(some.where("day(ts) = 7")), tmp_path, ["1990-01-01", "1993-06-01", "1993-06-02", "2030-01-01"])
    rows = run(live.stream_features(stream), tmp_path, "live_cold")
    assert len(rows) == some.count()
    same(rows, {k: v for k, v in features.items() if k[0] == "R"}, {})


def test_buffer_is_bounded():
    """However many bars come, a series holds the last 764, 251 rows and 20 states."""
    draw = np.random.default_rng(8)
    held, state, model = live.bar_frame([]), live.COLD, (np.array([0.5, 0.5]), np.full((2, 2), 0.5), np.zeros((2, 14)), np.repeat(np.eye(14)[None], 2, axis=0))
    at = 0
    for count in (1, 500, 3, 900, 50):
        close = 100 * np.exp(np.cumsum(draw.normal(0, 0.01, count)))
        new = live.pd.DataFrame({"us": np.arange(at, at + count), "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": draw.random(count)})
        held, state, out = live.advance(held, state, new, model)
        at += count
        assert len(out) == count and len(held) == min(at, 764) and state[0] == at
        assert len(state[2]) == 14 * min(at, 251) and len(state[4]) <= 20
    assert out["state_id"].notna().all()


def test_idle_state_goes(spark, rocks, stored_bars, tmp_path):
    """After the time to live a series begins anew: no feature but those of few bars."""
    rows = stored_bars.where("series_id = 'A'").orderBy("ts").limit(500)
    last = rows.agg(F.max("ts")).first()[0]
    stream = stream_of(spark, rows.where(F.col("ts") < F.lit(last)), tmp_path, ["1990-01-01", "2030-01-01"])
    query = live.stream_features(stream, ttl_ms=3000).writeStream.format("memory").queryName("live_ttl").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    def until(count):  # with a clock in use the query never comes to rest
        for _ in range(120):
            if spark.table("live_ttl").count() >= count:
                return
            time.sleep(0.5)

    try:
        until(499)
        time.sleep(4)
        rows.where(F.col("ts") == F.lit(last)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        until(500)
    finally:
        query.stop()
    got = {r.ts: r for r in spark.table("live_ttl").collect()}
    assert len(got) == 500
    before = got[sorted(got)[-2]]
    assert before.rsi is not None and not np.isnan(before.rsi)
    assert got[last].rsi is None or np.isnan(got[last].rsi)
