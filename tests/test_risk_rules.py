"""Rules on rows that the given tables lack."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.windows import ordered
from barloom.operators import decisions, indicators, regimes, risk
from barloom.sources import bars
from barloom.streaming import jobs
from barloom.streaming.latest import LatestSink


def test_flat_series_correlate_with_nothing(spark):
    rows = [(s, i, 1.0 if s == "flat" else float((i * k) % 7)) for s, k in (("flat", 0), ("a", 3), ("b", 5)) for i in range(70)]
    df = spark.createDataFrame(rows, "series_id string, n int, ret double").withColumn("ts", F.timestamp_seconds(F.col("n") * 86400))
    names = df.select("series_id").distinct()
    got = {r.candidate: r.max_correlation for r in risk.max_correlation(df, names, names).collect()}
    assert got["flat"] is None and -1 <= got["a"] <= 1 and abs(got["a"] - got["b"]) < 1e-12


def test_leverage_is_never_raised(spark):
    rows = [(0.5, 0.4, False), (1.5, 0.4, False), (1.5, 0.9, False), (0.75, 0.9, True), (1.25, 0.9, True)]
    df = spark.createDataFrame(rows, "leverage double, probability double, uncertain boolean").withColumns({"severity": F.lit(0), "open_positions": F.lit(0), "flicker": F.lit(0)})
    assert [r.leverage for r in risk.leverage_reasons(df).collect()] == [0.5, 1.0, 1.25, 0.75, 1.0]


def test_hints_of_unknown_labels(spark):
    df = spark.createDataFrame([("bull",), (None,), ("other",)], "label string")
    assert [(r.strategy, r.leverage) for r in regimes.attach_hints(df).collect()] == [("trend", 1.0), ("defensive", 0.0), ("defensive", 0.0)]


def test_a_leaky_feature_is_found(spark):
    """An average centred on its bar sees later bars; one that ends on it does not."""
    rows = [(s, i, float((i * k) % 11)) for s, k in (("a", 3), ("b", 5)) for i in range(40)]
    rows_of = spark.createDataFrame(rows, "series_id string, n int, close double").withColumn("ts", F.timestamp_seconds(F.col("n") * 86400))

    def features(df):
        w = ordered()
        return df.withColumns({"causal": F.avg("close").over(w.rowsBetween(-2, 0)), "leaky": F.avg("close").over(w.rowsBetween(-2, 2))})

    found = indicators.audit_lookahead(rows_of, features, ("causal", "leaky")).collect()
    assert {(r.series_id, r["column"]) for r in found} == {("a", "leaky"), ("b", "leaky")}


def test_indicators_do_not_depend_on_partitions(spark):
    rows = [(s, i, float(50 + (i * k) % 23)) for s, k in (("a", 3), ("b", 5)) for i in range(300)]
    rows_of = spark.createDataFrame(rows, "series_id string, n int, close double").withColumn("ts", F.timestamp_seconds(F.col("n") * 86400))
    rows_of = rows_of.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.col("close") * 3})
    once, many = (sorted(map(tuple, indicators.feature_matrix(rows_of.repartition(n)).collect())) for n in (1, 13))
    assert once == many and len(once) == 600


def test_silences_over_spans(spark):
    """A gap over many empty spans, equal times, a null time and a lone tick."""
    rows = [("a", t, i) for i, t in enumerate((0, 100, 100, 899, 901, 4000, 4301))] + [("a", None, 99), ("b", 7, 0)]
    ticks = spark.createDataFrame(rows, "series_id string, s int, i int").withColumn("ts", F.timestamp_seconds("s")).withColumn("seq", F.struct("ts", "i"))
    got = sorted((r.series_id, r.s, r.gap_seconds) for r in risk.feed_gaps(ticks, 300).collect())
    assert got == [("a", 899, 799.0), ("a", 4000, 3099.0), ("a", 4301, 301.0)]


def test_stability_index_of_odd_values(spark):
    """Equal sides give 0, one value gives 0, a side that is empty does not fail."""
    side = lambda rows: spark.createDataFrame(rows, "k string, value double")
    same = [("same", float(i)) for i in range(50)] + [("one", 1.0)] * 5
    got = {r.k: r.psi for r in regimes.psi(side(same), side(same + [("new", 1.0)]), ("k",)).collect()}
    assert got["same"] == 0.0 and got["one"] == 0.0
    moved = regimes.psi(side(same), side([("same", float(i + 40)) for i in range(50)]), ("k",)).collect()
    assert {r.k for r in moved} >= {"same"} and max(r.psi for r in moved) > 1
    assert regimes.psi(side([]), side([]), ("k",)).collect() == []


def test_account_state_of_unknown_accounts_and_names(spark):
    frame = spark.createDataFrame
    signals = frame([(1, "x", "a"), (2, "y", "b"), (3, None, "a")], "order_id long, account string, series_id string")
    accounts = frame([("x", 1000.0, 50.0, 1, False)], "account string, equity double, buying_power double, severity int, locked boolean")
    positions = frame([("x", "a", -40.0), ("x", "b", 0.0), ("x", "c", 60.0)], "account string, series_id string, market_value double")
    orders = frame([(1, "x", "a", "buy", 100), (9, "x", "a", "buy", 70), (2, "y", "b", "buy", 5)], "order_id long, account string, series_id string, side string, s int").withColumn("ts", F.timestamp_seconds("s"))
    sectors = frame([("a", "s1"), ("b", None), ("c", "s1")], "series_id string, sector string")
    returns = frame([(s, i, float((i * k) % 7)) for s, k in (("a", 3), ("b", 2), ("c", 3)) for i in range(40)], "series_id string, s int, ret double").withColumn("ts", F.timestamp_seconds(F.col("s") * 86400))
    got = {r.order_id: r for r in decisions.with_account_state(signals, accounts, positions, orders, sectors, returns).collect()}
    assert len(got) == 3
    assert (got[1].gross, got[1].open_positions, got[1].is_held, got[1].is_duplicate, got[1].trades_before, got[1].sector_gross) == (100.0, 2, True, True, 1, 100.0)
    assert abs(got[1].max_correlation - 1) < 1e-9
    assert (got[2].gross, got[2].is_held, got[2].equity, got[2].sector_gross, got[2].max_correlation) == (0.0, False, None, None, None)
    assert got[3].gross == 0.0 and not got[3].is_held


def test_rollback_needs_an_earlier_version(spark):
    versions = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1)], "series_id string, version int, s int").withColumn("ts", F.timestamp_seconds("s"))
    promoted = versions.where("version <> 3").unionByName(spark.createDataFrame([("c", 7, 1)], "series_id string, version int, s int").withColumn("ts", F.timestamp_seconds("s")))
    got = {r.series_id: (r.champion, r.rolled_back_to) for r in regimes.rollback(versions, promoted).collect()}
    assert got == {"a": (2, 1), "b": (1, None), "c": (7, None)}


def test_reports_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "series_id string, equity double")
    frames = {"equity_curve": df, "trade_log": df.select("equity"), "regime_history": df}
    assert bars.write_report(frames, str(tmp_path)) == ["equity_curve", "trade_log", "regime_history"]
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/equity_curve").select("series_id", "equity").collect()} == {("a", 1.0), ("b", 2.0)}


def test_latest_rows_are_kept_over_batches(spark, tmp_path):
    sink = LatestSink(f"{tmp_path}/latest")
    batch = lambda rows: spark.createDataFrame(rows, "series_id string, s int, v int").withColumn("ts", F.timestamp_seconds("s"))
    sink(batch([("a", 1, 10), ("a", 2, 11), ("b", 1, 20)]), 0)
    for _ in range(2):  # a batch that runs again gives the same
        sink(batch([("a", 1, 12), ("b", 3, 21), ("c", 1, 30)]), 1)
    got = {r.series_id: r.v for r in sink.read(spark).collect()}
    assert got == {"a": 11, "b": 21, "c": 30}


def test_wide_quotes_are_filtered(spark):
    quotes = spark.createDataFrame([("a", 100.0, 100.2), ("b", 100.0, 102.0), ("c", None, 5.0), ("d", 0.0, 5.0)], "series_id string, bid double, ask double")
    assert [r.series_id for r in jobs.stream_spread_filter(quotes).collect() if r.series_id in "ab"] == ["a"]


def test_open_part_of_silences(spark):
    """A gap over a closed night has none; what lies in open hours counts, over midnight too."""
    at = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute)
    gap = lambda k, a, b: (k, b, (b - a).total_seconds())
    gaps = [gap("a", at(1, 16), at(2, 9, 30)), gap("a", at(2, 12), at(3, 10)), gap("a", at(4, 9), at(4, 9, 35)), gap("b", at(1, 22), at(2, 2)), gap("b", at(1, 22), at(2, 2)), gap("c", at(1, 1), at(9, 1)), ("a", None, 5.0)]
    sessions = [("a", at(d, 9, 30), at(d, 16)) for d in (1, 2, 3, 4)] + [("b", at(1, 23), at(2, 1)), ("b", at(2, 5), at(2, 4)), ("b", None, at(2, 4))]
    frames = spark.createDataFrame(gaps, "series_id string, ts timestamp, gap_seconds double"), spark.createDataFrame(sessions, "series_id string, opens timestamp, closes timestamp")
    want = {("a", at(2, 12), at(2, 16), 14400.0), ("a", at(3, 9, 30), at(3, 10), 1800.0), ("b", at(1, 23), at(2, 1), 7200.0)}
    for days in (0.04, 1, 30):
        got = risk.open_gaps(*frames, 300, days).collect()
        assert {tuple(r) for r in got} == want and len(got) == 3


def test_correlations_in_blocks(spark):
    """Any block size gives what pairs of dates give; nulls and flat series among them."""
    draw = np.random.default_rng(6)
    rows = [(f"s{k}", dt.datetime(2024, 1, 1) + dt.timedelta(days=int(d)), None if draw.random() < 0.05 else 0.5 if k == 3 else float(draw.normal() + (k % 2) * d)) for k in range(9) for d in draw.choice(90, 80, replace=False)]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp, ret double")
    names = frame.select("series_id").distinct()
    last = {k: {t: v for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])[-60:] if v is not None} for k in {r[0] for r in rows}}
    want = {}
    for a in last:
        for b in last:
            shared = sorted(last[a].keys() & last[b].keys())
            if a != b and len(shared) >= 30:
                x, y = ([last[k][t] for t in shared] for k in (a, b))
                r = np.corrcoef(x, y)[0, 1] if np.std(x) > 0 and np.std(y) > 0 else -2.0
                want[a] = max(want.get(a, -2.0), r)
    for block in (2, 256):
        got = {r.candidate: r.max_correlation for r in risk.max_correlation(frame, names, names.where("series_id <> 's5'").union(names.where("series_id = 's5'")), block=block).collect()}
        assert got.keys() == want.keys() and got["s3"] is None
        assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items() if v > -2)
    assert risk.max_correlation(frame.limit(0), names, names).count() == 0


def test_marks_as_of(spark):
    """The last close at or before a position, over empty spans; none before the first."""
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    prices = spark.createDataFrame([("a", at(0), 10.0), ("a", at(5), 12.0), ("a", at(6), None), ("a", at(40), 9.0), (None, at(0), 3.0)], "series_id string, ts timestamp, close double")
    positions = spark.createDataFrame([("a", at(n), 2.0, 8.0) for n in (-1, 0, 4, 5, 6, 39, 40, 99)] + [("b", at(0), 1.0, 1.0), (None, at(1), 1.0, 1.0)], "series_id string, ts timestamp, qty double, avg_price double")
    for days in (1, 7, 4096):
        got = {(r.series_id, r.ts): (r.mark, r.market_value, r.unrealized) for r in risk.mark_asof(positions, prices, days).collect()}
        assert {(at(n), got["a", at(n)][0]) for n in (-1, 0, 4, 5, 6, 39, 40, 99)} == {(at(-1), None), (at(0), 10.0), (at(4), 10.0), (at(5), 12.0), (at(6), 12.0), (at(39), 12.0), (at(40), 9.0), (at(99), 9.0)}
        assert got["a", at(40)] == (9.0, 18.0, 2.0) and got["b", at(0)][0] is None and got[None, at(1)][0] == 3.0 and len(got) == 10


def test_decision_log_is_appended(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 10, m), "regime", m % 3, 0.5, 100.0, None, 1.0, "x") for m in range(30)] + [("b", dt.datetime(2024, 1, 2), "veto", None, None, 5.0, 1.0, 0.0, None)]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp, event string, regime int, probability double, equity double, day_result double, exposure double, note string")
    folder = f"{tmp_path}/log"
    decisions.append_decisions(frame.where("minute(ts) < 10"), folder)
    decisions.append_decisions(frame.where("minute(ts) >= 10"), folder)
    log = spark.read.parquet(folder)
    got = decisions.recent_decisions(log).collect()
    assert log.count() == 31 and sorted(r.ts.minute for r in got if r.series_id == "a") == list(range(10, 30))
    assert [tuple(r)[2:] for r in got if r.series_id == "b"] == [("veto", None, None, 5.0, 1.0, 0.0)]
    assert {r.series_id for r in decisions.recent_decisions(log, since="2024-01-02").collect()} == {"b"}


def test_a_ledger_goes_on_over_batches(spark):
    """Series of one row and of many more than a batch, one without a name, ties in time."""
    draw, rows, want = random.Random(5), [], {}
    for name, count in (("a", 1), ("b", 700), (None, 300), ("c", 2), ("d", 1)):
        held = avg = 0.0
        for i in range(count):
            side, qty, price = ("buy", "sell")[draw.random() < 0.45], float(draw.randint(1, 9)), draw.randint(1, 99) / 4
            made = 0.0
            if side == "buy":
                held, avg = held + qty, (held * avg + qty * price) / (held + qty)
            elif held > 0:
                closed = min(qty, held)
                made, held = (price - avg) * closed, held - closed
                avg = avg if held > 1e-9 else 0.0
            rows.append((name, dt.datetime(2024, 1, 1) + dt.timedelta(days=i // 3), f"{i:05d}", side, qty, price))
            want[name, f"{i:05d}"] = (held, avg, made)
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp, fill_id string, side string, qty double, price double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (size, "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            ledger = risk.fill_ledger(frame)
            assert "FlatMapGroupsInPandas" not in ledger._jdf.queryExecution().toString()  # no series is one group
            assert {(r.series_id, r.fill_id): (r.held, r.avg_price, r.realized) for r in ledger.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
