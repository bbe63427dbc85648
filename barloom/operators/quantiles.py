"""Exact quantiles and the stability index of large groups, by sketches and counts.

A mergeable sketch (KLL) of each group places the borders of some cells; rows are
only counted by cell. Counts are exact, so they tell in which cell an order
statistic lies and which one of the cell's it is: only the values of those cells
are looked at. The sketch's error changes how many values a cell has (about the
group's share of one in ``CELLS``, with an error of about one in a hundred for
k = 200), never the result. No task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.lineage import stored
from barloom.functions.spans import renewed, same_keys

CELLS, SKETCH = 64, 200
#: Bytes of per-group tables up to which they are broadcast; beyond, groups are met by a shuffled join.
BROADCAST = 16 << 20


def at_most(sorted_values: Column, value: Column, most: int = CELLS) -> Column:
    """How many of an ascending array's values are <= ``value``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_values, at + step - 1) <= value, at + step).otherwise(at))


def meet(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Each row with its group's columns. ``groups`` (stored, one row a key) is broadcast
    if it has at most ``BROADCAST`` bytes at ``size`` a row."""
    if groups.count() * size > BROADCAST:
        return same_keys(rows, groups, keys)
    renamed = renewed(groups).select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in groups.columns])
    equal = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]
    return rows.join(F.broadcast(renamed), equal).drop(*[f"_key_{c}" for c in keys])


class Cells:
    """Flagged values dealt to cells: ``flagged`` has keys, _v (double) and _e, true
    for the rows whose quantiles are asked for. Null and NaN values are left out."""

    def __init__(self, flagged: DataFrame, keys: Sequence[str], probabilities: Sequence[float]):
        self.keys, self.probabilities = list(keys), list(probabilities)
        own, flagged = self.keys, flagged.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        ranks = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
        sketch = flagged.where("_e").groupBy(*own).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_k"), F.count("*").alias("_n"))
        groups = stored(sketch.select(*own, "_n", F.array_sort(F.array_distinct(F.kll_sketch_get_quantile_double("_k", ranks))).alias("_borders")), "cells")
        self.rows = meet(flagged, groups, own, 8 * CELLS).select(*own, "_v", "_e", at_most(F.col("_borders"), F.col("_v")).alias("_cell"), F.col("_n"), "_borders")
        counted = self.rows.groupBy(*own, "_cell").agg(F.count_if("_e").alias("_ne"), F.count_if(~F.col("_e")).alias("_na"), F.max("_n").alias("_n"), F.max("_borders").alias("_borders"))
        order = Window.partitionBy(*own).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("_start", F.coalesce(F.sum("_ne").over(order), F.lit(0)))
        wanted = F.array_distinct(F.flatten(F.array(*[F.array(i, F.least(i + 1, F.col("_n") - 1)) for i in (F.floor((F.col("_n") - 1) * p) for p in self.probabilities)])))
        inside = F.filter(wanted, lambda i: (i >= F.col("_start")) & (i < F.col("_start") + F.col("_ne")))
        self.counts = stored(placed.select(*own, "_cell", "_ne", "_na", "_n", "_start", F.get("_borders", F.col("_cell") - 1).alias("_low"), inside.alias("_wanted")), "cell-counts")
        sought = self.counts.where(F.size("_wanted") > 0).select(*own, "_cell", "_start", "_wanted")
        fine = meet(self.rows.select(*own, "_v", "_e", "_cell"), sought, [*own, "_cell"], 8 * (8 + len(self.probabilities)))
        #: Values of the cells that hold an order statistic, counted.
        self.fine = stored(fine.groupBy(*own, "_cell", "_v").agg(F.count_if("_e").alias("_ne"), F.count_if(~F.col("_e")).alias("_na"), F.max(F.struct("_start", "_wanted")).alias("_s")), "cell-values")

    def quantiles(self) -> DataFrame:
        """keys, quantiles: one for each probability, interpolated between neighbours."""
        order = Window.partitionBy(*self.keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("_s._start") + F.coalesce(F.sum("_ne").over(order), F.lit(0))
        held = self.fine.where("_ne > 0").withColumn("_first", first)
        held = held.select(*self.keys, "_v", F.explode(F.filter("_s._wanted", lambda i: (i >= F.col("_first")) & (i < F.col("_first") + F.col("_ne")))).alias("_i"))
        known = held.groupBy(*self.keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
        n = self.counts.groupBy(*self.keys).agg(F.max("_n").alias("_n"))
        both = same_keys(known, n, self.keys)

        def one(p: float) -> Column:
            place = (F.col("_n") - 1) * p
            low = F.try_element_at("_m", F.floor(place))
            high = F.try_element_at("_m", F.least(F.floor(place) + 1, F.col("_n") - 1))
            return low + (place - F.floor(place)) * (high - low)

        return both.select(*self.keys, F.array(*[one(p) for p in self.probabilities]).alias("quantiles"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """keys, quantiles: linearly interpolated, exact. Groups without values are left out."""
    flagged = df.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(True).alias("_e"))
    return Cells(flagged, keys, probabilities).quantiles()


def stability_index(flagged: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """keys, psi: population stability index of the rows without _e on the deciles of
    those with it. Fewer than two different edges give 0; a key without expected
    rows is left out.

    Cells without an order statistic lie between two edges: they are counted whole.
    """
    keys = list(keys)
    cells = Cells(flagged, keys, [i / bins for i in range(bins + 1)])
    edges = cells.quantiles().select(*keys, F.array_distinct("quantiles").alias("_edges"))
    edges = stored(edges.select(*keys, F.size("_edges").alias("n_edges"), F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0))).alias("_inner")), "edges")
    whole = cells.counts.where(F.size("_wanted") == 0).select(*keys, F.coalesce("_low", F.lit(float("-inf"))).alias("_v"), "_ne", "_na")
    values = whole.unionByName(cells.fine.select(*keys, "_v", "_ne", "_na"))
    met = meet(values, edges, keys, 8 * bins)
    both = met.groupBy(*keys, "n_edges", at_most(F.col("_inner"), F.col("_v"), bins).alias("bin")).agg(F.sum("_ne").alias("_ne"), F.sum("_na").alias("_na"))
    share = lambda c: F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy(*keys))) + 1e-6
    shares = both.select(*keys, "n_edges", share("_ne").alias("e"), share("_na").alias("a"))
    total = shares.groupBy(*keys).agg(F.max("n_edges").alias("n_edges"), F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))
    return total.select(*keys, F.when(F.col("n_edges") < 2, 0.0).otherwise(F.coalesce("psi", F.lit(0.0))).alias("psi"))
