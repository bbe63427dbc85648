"""Scans over spans equal the plain recurrences; pooled fits find planted models."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import pooled, risk, scans
from barloom.operators import regimes as reg

DAY = dt.datetime(1999, 12, 1)


def walk(series, n, seed=0, step=1):
    draw, close, rows = np.random.default_rng(seed), 100.0, []
    for i in range(n):
        close *= float(np.exp(draw.normal(0, 0.02)))
        low, high = close * (1 - 0.01 * draw.random()), close * (1 + 0.01 * draw.random())
        rows.append((series, DAY + dt.timedelta(days=step * i), close, float(high), float(low), close, 1.0))
    return rows


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "series_id string, ts timestamp, open double, high double, low double, close double, volume double")


def wilder(x, n, first=0):
    out = [None] * len(x)
    for i in range(first + n - 1, len(x)):
        out[i] = sum(x[first : first + n]) / n if i == first + n - 1 else (out[i - 1] * (n - 1) + x[i]) / n
    return out


def plain_indicators(rows, n=14):
    high, low, close = ([r[k] for r in rows] for k in (3, 4, 5))
    ranges, plus, minus, up, down, ema = [], [], [], [], [], []
    for i in range(len(rows)):
        pc, ph, pl = (close[i - 1], high[i - 1], low[i - 1]) if i else (None,) * 3
        ranges.append(high[i] - low[i] if i == 0 else max(high[i] - low[i], abs(high[i] - pc), abs(low[i] - pc)))
        rise, fall, change = (high[i] - ph, pl - low[i], close[i] - pc) if i else (0, 0, 0)
        plus.append(rise if rise > fall and rise > 0 else 0.0)
        minus.append(fall if fall > rise and fall > 0 else 0.0)
        for x, v in ((up, max(change, 0.0)), (down, max(-change, 0.0))):
            x.append(v if i == 0 else x[-1] + (v - x[-1]) / n)
        ema.append(close[i] if i == 0 else ema[-1] + (close[i] - ema[-1]) * 2 / 51)
    atr, (r, p, m) = wilder(ranges, n), (wilder(x, n, 1) for x in (ranges, plus, minus))
    dx = [None if a is None else 100 * abs(b - c) / (b + c) if a > 0 and b + c > 0 else 0.0 for a, b, c in zip(r, p, m)]
    adx = wilder(dx, n, n)
    rsi = [None if i < n - 1 else 100.0 if down[i] == 0 else 100 - 100 / (1 + up[i] / down[i]) for i in range(len(rows))]
    return [(e, a or 0.0, s, d or 0.0) for e, a, s, d in zip(ema, atr, rsi, adx)]


@pytest.mark.parametrize("days", [3, 29, 4096])
def test_recurrences_over_spans(spark, days):
    groups = {"a": walk("a", 300, 1), "b": walk("b", 40, 2, step=20), "c": walk("c", 1), "d": walk("d", 14, 3), None: walk(None, 50, 4)}
    frame = bars_of(spark, [r for rows in groups.values() for r in rows]).repartition(5)
    got = {(r.series_id, r.ts): (r.ema, r.atr, r.rsi, r.adx) for r in ind.add_recurrences(frame, days=days).collect()}
    ema = {(r.series_id, r.ts): r.ema for r in ind.add_ema(frame, days=days).collect()}
    atr = {(r.series_id, r.ts): r.atr for r in ind.add_atr(frame, warmup=None, days=days).collect()}
    assert len(got) == sum(map(len, groups.values()))
    for name, rows in groups.items():
        for i, (row, want) in enumerate(zip(rows, plain_indicators(rows))):
            here = got[name, row[1]]
            assert [v is None for v in here] == [v is None for v in want], (name, i)
            assert [v or 0.0 for v in here] == pytest.approx([v or 0.0 for v in want], abs=1e-9, rel=1e-9), (name, i)
            assert ema[name, row[1]] == pytest.approx(want[0]) and (atr[name, row[1]] is None) == (i < 13)


def test_a_long_series_is_many_tasks(spark):
    frame = bars_of(spark, walk("hot", 400))
    edges = scans.span_edges(scans.spanned(frame, 20), ("close",)).collect()
    assert len(edges) >= 20 and sum(e._last for e in edges) == 1 and [e._offset for e in sorted(edges, key=lambda e: e._span)][:2] == [0, edges and min(e._offset for e in edges if e._offset)]
    assert ind.add_ema(bars_of(spark, []), days=5).count() == 0


def test_affine_maps_that_grow(spark):
    """Any maps, not only averages: compounding deposits."""
    frame = spark.createDataFrame([("s", DAY + dt.timedelta(days=i), 0.01 * (i % 7 - 3), float(i)) for i in range(100)], "series_id string, ts timestamp, rate double, paid double")
    maps = lambda g, offset, before: {"v": (1 + g["rate"].to_numpy(), g["paid"].to_numpy())}
    got = scans.affine_scan(frame, maps, lambda g, v, offset: {"value": v["v"]}, {"value": "double"}, (), days=6).orderBy("ts").collect()
    value = 0.0
    for r in got:
        value = value * (1 + r.rate) + r.paid
        assert r.value == pytest.approx(value)


MODEL = ([0.6, 0.4, 0.0], [[0.95, 0.05, 0.0], [0.1, 0.8, 0.1], [0.0, 0.3, 0.7]], [[0.0, 1.0], [0.5, -1.0], [3.0, 3.0]], [[[1.0, 0.2], [0.2, 1.0]]] * 2 + [[[1e-6, 0.0], [0.0, 1e-6]]])


@pytest.mark.parametrize("days", [2, 31])
def test_filtering_over_spans(spark, days):
    draw = np.random.default_rng(3)
    rows = [(k, DAY + dt.timedelta(days=i), float(x), float(y)) for k, n in (("a", 200), ("b", 1), ("c", 35), ("no model", 5)) for i, (x, y) in enumerate(draw.normal(size=(n, 2)) * 2)]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp, x double, y double")
    models = spark.createDataFrame([(k, *MODEL) for k in "abc"], "series_id string, startprob array<double>, transmat array<array<double>>, means array<array<double>>, covars array<array<array<double>>>")
    got = {(r.series_id, r.ts): r for r in reg.regime_proba(frame, models, ("x", "y"), days=days).collect()}
    assert len(got) == 236
    for k in "abc":
        own = [r for r in rows if r[0] == k]
        emission = reg.log_emission(np.array([r[2:] for r in own]), *map(np.array, MODEL[2:]))
        post, norm = reg.forward(emission, np.array(MODEL[0]), np.array(MODEL[1]))
        for r, p, n in zip(own, np.exp(post), norm):
            assert np.allclose(got[k, r[1]].probabilities, p, atol=1e-9) and got[k, r[1]].log_likelihood == pytest.approx(n, abs=1e-8)


def brute_passed(alerts, seconds):
    passed, last = set(), {}
    for key, ts, one in sorted((a for a in alerts if a[1] is not None), key=lambda a: (str(a[0]), a[1], a[2])):
        if key not in last or (ts - last[key]).total_seconds() >= seconds:
            passed.add((key, one))
            last[key] = ts
    return passed


@pytest.mark.parametrize("days", [0.0105, 1, 30])
def test_spacing_by_pointer_jumping(spark, days):
    draw, alerts = random.Random(9), []
    for i in range(3000):  # a hot key, ties, rows exactly fifteen minutes apart, long silences
        key = draw.choice(["hot"] * 8 + ["b", None])
        ts = dt.datetime(1969, 12, 31) + dt.timedelta(minutes=draw.choice([1, 5, 15]) * draw.randint(0, 900), microseconds=draw.choice([0, 0, 1, 999999]))
        alerts.append((key, ts + dt.timedelta(days=draw.choice([0, 0, 0, 40])), i))
    alerts += [("b", None, 5000), ("once", dt.datetime(2020, 1, 1), 5001)]
    frame = spark.createDataFrame(alerts, "event_key string, ts timestamp, alert_id long")
    got = risk.rate_limit(frame.repartition(6), 15.0, days=days).collect()
    assert len(got) == len(alerts) and all(r.passed is not None for r in got)
    assert {(r.event_key, r.alert_id) for r in got if r.passed} == brute_passed(alerts, 900)
    assert risk.rate_limit(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        risk.rate_limit(frame, 15.0, days=0.01)


TRUE_MOVES = np.array([[0.95, 0.05], [0.1, 0.9]])


def planted(count, length, seed=4):
    draw, rows = np.random.default_rng(seed), []
    for s in range(count):
        state = int(draw.random() < 0.4)
        for i in range(length):
            rows.append((f"s{s}", DAY + dt.timedelta(days=i), float(draw.normal((-1.0, 2.0)[state], (0.5, 1.0)[state])), float(draw.normal((0.0, 1.0)[state], 1.0))))
            state = int(draw.random() < TRUE_MOVES[state, 1])
    return pd.DataFrame(rows, columns=["series_id", "ts", "x", "y"])


def test_pooled_fit_recovers_a_planted_model(spark):
    frame = spark.createDataFrame(planted(1000, 20)).repartition(7)
    fits = {(r.n, r.seed): r for r in pooled.fit_pooled_models(frame, ("x", "y"), [(2, 42), (2, 43), (3, 42)], rows=1000, iterations=60).collect()}
    fit = fits[2, 42]
    assert fit.converged and fit.n_rows == 20000 and all(b >= a - 1e-6 for a, b in zip(fit.trace, fit.trace[1:]))
    order = np.argsort([m[0] for m in fit.means])
    assert np.allclose(np.array(fit.means)[order], [[-1, 0], [2, 1]], atol=0.06)
    assert np.allclose(np.array(fit.transmat)[order][:, order], TRUE_MOVES, atol=0.02)
    assert np.allclose(np.array(fit.startprob)[order], [0.6, 0.4], atol=0.06)
    assert fits[2, 43].log_likelihood == pytest.approx(fit.log_likelihood, abs=1.0)
    chosen = reg.select_model(spark.createDataFrame([tuple(r) for r in fits.values()], pooled.fit_pooled_models(frame.limit(0), ("x", "y")).schema).withColumn("model", F.lit("pooled")), 2, ("model",))
    assert [r.n for r in chosen.collect()] == [2]


def test_pooled_fit_of_one_sequence_is_the_single_fit(spark):
    frame = planted(1, 700)
    x = frame[["x", "y"]].to_numpy()
    means = reg.starting_means(x, 3, 42)
    start, moves, centres, covars, trace = reg.expectation_maximisation(x, 3, 42, 100, 1e-3, 1e-2, 1e-2)
    base = np.cov(x.T) + 1e-3 * np.eye(2)
    given = {(3, 42): (np.full(3, 1 / 3), np.full((3, 3), 1 / 3), means, np.repeat(base[None], 3, axis=0))}
    fit = pooled.fit_pooled_models(spark.createDataFrame(frame), ("x", "y"), starts=given).first()
    assert np.allclose(fit.trace, trace, rtol=0, atol=1e-6) and len(fit.trace) == len(trace)
    assert np.allclose(fit.means, centres, atol=1e-7) and np.allclose(fit.transmat, moves, atol=1e-7) and np.allclose(fit.covars, covars, atol=1e-7)


def test_pooled_fit_without_enough_rows(spark):
    empty = spark.createDataFrame(planted(2, 20)).withColumn("y", F.when(F.col("series_id") == "s0", F.col("y")))
    fit = pooled.fit_pooled_models(empty, ("x", "y")).first()
    assert fit.means is None and fit.log_likelihood == float("-inf") and not fit.converged and fit.n_rows == 20
    assert pooled.fit_pooled_models(empty, ("x", "y"), least_rows=2, iterations=3).first().log_likelihood > float("-inf")


def test_sequences_keep_together_over_batches():
    rows = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 2 + [None] * 4 + ["c"], "x": np.arange(12.0)})
    for size in (1, 2, 3, 12):
        batches = [rows.iloc[i : i + size] for i in range(0, 12, size)]
        got = list(pooled.sequences(iter(batches), ["k"], ["x"], 4))
        assert np.concatenate([x for x, _ in got]).ravel().tolist() == list(range(12))
        assert [n for _, lengths in got for n in lengths.tolist()] == [5, 2, 4, 1]


def test_blocks_by_time_give_each_sequences_own_sums():
    draw = np.random.default_rng(9)
    lengths = np.array([3, 1, 7, 7, 2, 40])
    x = draw.normal(size=(lengths.sum(), 2))
    model = (np.array([0.7, 0.3]), TRUE_MOVES, np.array([[-1.0, 0.0], [1.0, 0.5]]), np.stack([np.eye(2), [[2.0, 0.3], [0.3, 0.5]]]))
    columns, alive, at = pooled.by_time(x, lengths)
    assert sorted(at.tolist()) == list(range(len(x))) and alive[0] == 6 and alive.sum() == len(x) and np.array_equal(columns.T, x[at])
    parts = [pooled.expected_sums(*pooled.by_time(part, np.array([len(part)]))[:2], model) for part in np.split(x, np.cumsum(lengths)[:-1])]
    assert np.allclose(pooled.expected_sums(columns, alive, model), np.sum(parts, axis=0), rtol=0, atol=1e-9)
    likely = [reg.forward(reg.log_emission(part, *model[2:]), *model[:2])[1].sum() for part in np.split(x, np.cumsum(lengths)[:-1])]
    assert pooled.expected_sums(columns, alive, model)[0] == pytest.approx(sum(likely), abs=1e-9)


def test_a_gain_for_each_row_ends_a_fit_sooner(spark):
    frame = spark.createDataFrame(planted(40, 30))
    close, wide = (pooled.fit_pooled_models(frame, ("x", "y"), [(2, 42)], row_gain=g).first() for g in (0.0, 1e-2))
    assert len(wide.trace) < len(close.trace) and wide.trace == pytest.approx(close.trace[: len(wide.trace)], abs=1e-6)
    assert wide.trace[-1] - wide.trace[-2] < 12.0 <= min(np.diff(wide.trace[:-1]))


def test_one_model_scores_all_sequences_as_the_filter_does(spark):
    rows = planted(30, 25)
    rows = spark.createDataFrame(pd.concat([rows[rows.series_id != "s3"], rows[rows.series_id == "s3"][:1]])).repartition(5)
    model = (np.array([0.6, 0.4]), TRUE_MOVES, np.array([[-1.0, 0.0], [2.0, 1.0]]), np.stack([np.eye(2), [[2.0, 0.3], [0.3, 0.5]]]))
    named = spark.createDataFrame([tuple(np.asarray(v).tolist() for v in model)], "startprob array<double>, transmat array<array<double>>, means array<array<double>>, covars array<array<array<double>>>")
    want = {(r.series_id, r.ts): r for r in reg.regime_proba(rows, rows.select("series_id").distinct().crossJoin(named), ("x", "y")).collect()}
    for block in (1, 100, 10000):
        got = pooled.score_pooled(rows, model, ("x", "y"), rows=block)
        assert got.columns == reg.regime_proba(rows, rows.select("series_id").distinct().crossJoin(named), ("x", "y")).columns
        got = got.collect()
        assert len(got) == len(want) == 29 * 25 + 1
        for r in got:
            w = want[r.series_id, r.ts]
            assert (r.x, r.y, r.state_id, r.vol_rank) == (w.x, w.y, w.state_id, w.vol_rank)
            assert np.allclose([*r.probabilities, r.probability, r.log_likelihood], [*w.probabilities, w.probability, w.log_likelihood], rtol=0, atol=1e-9)
    assert pooled.score_pooled(rows.limit(0), model, ("x", "y")).count() == 0
