"""Exact quantiles and stability indices of large, tied and tiny groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import quantiles


def groups():
    draw = np.random.default_rng(11)
    return {
        "large": draw.normal(size=20000),
        "tied": np.repeat([1.0, 2.0, 3.0], [9000, 50, 2]),
        "half": np.concatenate([np.full(4000, 5.0), draw.exponential(size=4000)]),
        "few": np.array([3.0, 1.0, 2.0]),
        "one": np.array([7.0]),
        "wild": np.array([float("inf"), float("-inf"), 1e308, -1e308, 0.0, 5e-324]),
        None: draw.integers(0, 50, 1000).astype(float),
    }


def frame_of(spark, values, extra=()):
    rows = [(k, float(v)) for k, x in values.items() for v in x] + list(extra)
    return spark.createDataFrame(rows, "k string, value double").repartition(6)


@pytest.mark.parametrize("broadcast", [True, False])
def test_quantiles_are_exact(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quantiles, "BROADCAST", 0)
    probabilities = [0.0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    known = {k: v for k, v in groups().items() if k != "wild"}
    frame = frame_of(spark, known, [("few", None), ("few", float("nan")), ("nothing", None)])
    got = {r.k: r.quantiles for r in quantiles.exact_quantiles(frame, ("k",), "value", probabilities).collect()}
    assert set(got) == set(known)
    for k, v in known.items():
        assert got[k] == pytest.approx(np.quantile(v, probabilities).tolist(), rel=1e-12), k


def test_no_cell_holds_a_group(spark):
    flagged = frame_of(spark, groups()).select("k", F.col("value").alias("_v"), F.lit(True).alias("_e"))
    cells = quantiles.Cells(flagged, ("k",), [0.5])
    assert cells.counts.where("k = 'large'").agg(F.max("_ne")).first()[0] < 20000 / 20
    assert cells.fine.where("k = 'large'").count() < 20000 / 20
    assert cells.fine.where("k = 'tied'").count() <= 3


def plain_index(expected, actual):
    edges = np.unique(np.quantile(expected, np.linspace(0, 1, 11)))
    if len(edges) < 2:
        return 0.0
    count = lambda x: np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=len(edges) - 1) / max(len(x), 1) + 1e-6
    e, a = count(expected), count(actual)
    return float(((a - e) * np.log(a / e)).sum())


def test_stability_index(spark):
    known = {k: v for k, v in groups().items() if k not in ("wild", "nothing")}
    draw = np.random.default_rng(12)
    actual = {k: np.concatenate([draw.choice(v, 500) + 0.25, draw.normal(2, 3, 500)]) for k, v in known.items()}
    flagged = frame_of(spark, known).withColumn("_e", F.lit(True)).unionByName(frame_of(spark, actual, [("only actual", 1.0)]).withColumn("_e", F.lit(False)))
    got = {r.k: r.psi for r in quantiles.stability_index(flagged.withColumnRenamed("value", "_v"), ("k",)).collect()}
    assert set(got) == set(known)
    for k, v in known.items():
        assert got[k] == pytest.approx(plain_index(v, actual[k]), abs=1e-9), k
