"""Walk-forward states: test bars only, each once, at most a fold's length."""

from collections import Counter

from barloom.plans import registry


def test_folds_are_cut_to_test_bars(spark, sf_dir):
    rows = registry.QUERIES["f3_walk_forward_states"](spark, sf_dir).collect()
    assert rows and max(Counter((r.series_id, r.ts) for r in rows).values()) == 1
    assert max(Counter((r.series_id, r.fold_id) for r in rows).values()) <= 126
    assert any(r.consecutive_bars > 1 for r in rows) and all(0 <= r.flicker <= 19 for r in rows)


def test_permuted_map_is_stable(spark, sf_dir):
    first, again = (sorted(map(tuple, registry.QUERIES["d9_permuted_map"](spark, sf_dir).collect())) for _ in range(2))
    assert first == again and {r[3] for r in first} == {0, 1, 2}


def test_registered_fits_run_until_they_converge(spark, sf_dir):
    fits = registry.QUERIES["c1_fit_regime_models"](spark, sf_dir).collect()
    assert fits and all(r.converged and 15 < r.iterations < 100 for r in fits if r.n_rows >= 504)
