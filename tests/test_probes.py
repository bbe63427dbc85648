"""Drawn shocks, shuffled maps and model selection against plain versions."""

import numpy as np

from barloom.operators import probes
from barloom.operators import regimes as reg
from barloom.plans import probe_queries as plans


def test_shocks_scale_later_prices_only(spark, sf_dir):
    rows = probes.numbered(plans.returns(spark, sf_dir)).where("series_id = 'N'")
    events = spark.createDataFrame([(1, "N", 300, -0.1), (1, "N", 300, -0.2), (2, "N", 5, 0.0)], "scenario_id long, series_id string, ordinal long, shock double")
    base = rows.orderBy("ts").toPandas()["ret"].to_numpy()
    got = probes.shocked_returns(rows, events).orderBy("ts").toPandas()
    price = np.cumprod(1 + base)
    want = np.where(np.arange(len(base)) >= 300, price * 0.9 * 0.8, price)
    assert np.allclose(np.cumprod(1 + got[got.scenario_id == 1]["ret"].to_numpy()), want)
    assert np.allclose(got[got.scenario_id == 2]["ret"].to_numpy(), base)


def test_hashed_draws_lie_in_their_range(spark):
    counts = spark.createDataFrame([("a", 2000), ("b", 40), ("c", 1), ("d", 3)], "series_id string, n long")
    rows = probes.draw_events(counts, 50, 10, probes.hashed(7)).collect()
    place = {k: [r.ordinal for r in rows if r.series_id == k] for k in "abcd"}
    assert len(place["a"]) == 500 and min(place["a"]) >= 500 and max(place["a"]) < 1998 and len(set(place["a"])) > 200
    assert set(place["b"]) <= set(range(20, 38)) and not place["c"] and set(place["d"]) == {1}
    assert all(0 <= r.u < 1 for r in rows) and 0.4 < np.mean([r.u for r in rows]) < 0.6


def test_probes_and_skill(spark, sf_dir):
    report = {(r.probe, r.name): r for r in plans.f12(spark, sf_dir).collect()}
    assert {p for p, _ in report} == {"crash", "gap", "misclassification"} and len(report) == 9
    assert all(r.paths == plans.SIMS and r.worst_max_loss <= r.mean_max_loss <= 0 for r in report.values())
    assert all(-1.5 <= report["crash", k].expected_loss <= -0.5 for k in "ANR")
    for r in plans.f17(spark, sf_dir).collect():
        assert r.shuffles == plans.SIMS and abs(r.margin_sharpe - (r.real_sharpe - r.shuffled_sharpe)) < 2e-6


def test_model_selection(spark, sf_dir):
    fits = plans.model_grid(spark, sf_dir).select("series_id", "n", "seed", "log_likelihood", "n_rows").toPandas()
    assert len(fits) == 18
    best = fits.sort_values(["log_likelihood", "seed"], ascending=[False, True]).groupby(["series_id", "n"], as_index=False).first()
    free = (best.n - 1) + best.n * (best.n - 1) + best.n * 2 + best.n * 3
    best["bic"] = -2 * best.log_likelihood + free * np.log(best.n_rows)
    want = best.sort_values(["bic", "n"]).groupby("series_id").first()
    for r in plans.c2(spark, sf_dir).collect():
        assert (r.n, r.seed) == (want.n[r.series_id], want.seed[r.series_id]) and abs(r.bic - want.bic[r.series_id]) < 1e-3


def test_volatility_ranks_follow_the_first_feature():
    covars = np.array([[[3.0]], [[1.0]], [[2.0]]])
    assert reg.volatility_ranks(covars).tolist() == [1.0, 0.0, 0.5] and reg.volatility_ranks(covars[:1]).tolist() == [0.0]
