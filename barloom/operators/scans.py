"""Recurrences over long series as scans: no task holds a whole series.

A step v -> a*v + b is an affine map, and maps compose into one pair. Each span
of a series is first composed into its pair, the few pairs of a series are
folded into the value that each span starts from, and then the spans run side
by side from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.lineage import stored
from barloom.functions.spans import DAYS, followed, per_span, renewed, same_keys, schema_of, span_edges, spanned
from barloom.functions.windows import SERIES, TS

#: From a span's rows, the series' rows before it and the last of these (None: none): (a, b) of each step by name.
Maps = Callable[[pd.DataFrame, int, "np.ndarray | None"], dict[str, tuple[np.ndarray, np.ndarray]]]


def steps(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """v = a*v + b at each place, from ``start`` before the first."""
    return np.fromiter(accumulate(zip(a.tolist(), b.tolist(), strict=True), lambda v, m: m[0] * v + m[1], initial=start), float, len(a) + 1)[1:]


def affine_scan(df: DataFrame, maps: Maps, finish: Callable[[pd.DataFrame, dict[str, np.ndarray], int], dict], out: dict[str, str], columns: Sequence[str], keys: Sequence[str] = (SERIES,), days: float = DAYS) -> DataFrame:
    """Columns ``out`` that ``finish`` makes of the values of some recurrences.

    ``maps`` may read ``columns``, of its rows and of the row before them. Every
    recurrence starts from 0; a map with a = 0 starts it anew.
    """
    rows = spanned(df.drop(*out), days, keys)
    edges = span_edges(rows, columns, keys)
    own = [*keys, "_span"]

    def made(group: pd.DataFrame, edge: pd.Series) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        before = edge["_before"]
        return maps(group, int(edge["_offset"]), None if before is None else np.asarray(before, float))

    def compose(group: pd.DataFrame, edge: pd.Series) -> pd.DataFrame:
        pairs = [x for a, b in made(group, edge).values() for x in (a.prod(), steps(a, b, 0.0)[-1])]
        return pd.DataFrame({k: [edge[k]] for k in own} | {"_pairs": [pairs]})

    def carry(spans: pd.DataFrame) -> pd.DataFrame:
        spans, value, found = spans.sort_values("_span"), None, []
        for pairs in spans["_pairs"]:
            pairs = np.asarray(pairs, float)
            value = pairs[1::2] + (pairs[0::2] * value if value is not None else 0.0)
            found.append(value.tolist())
        return spans[own].assign(_carry=found)

    pairs = per_span(followed(rows, edges, keys), edges, keys, compose, schema_of(rows, own, _pairs="array<double>"))
    ends = pairs.groupBy(*keys).applyInPandas(carry, schema_of(rows, own, _carry="array<double>"))
    # the value at a span's end is where the next span starts
    order = Window.partitionBy(*keys).orderBy("_span")
    starts = same_keys(edges, ends, own, "left").withColumn("_carry", F.lag("_carry").over(order))

    def run(group: pd.DataFrame, edge: pd.Series) -> pd.DataFrame:
        terms = made(group, edge)
        carried = [0.0] * len(terms) if edge["_carry"] is None else edge["_carry"]
        values = {name: steps(a, b, float(v)) for (name, (a, b)), v in zip(terms.items(), carried, strict=True)}
        return group.assign(**finish(group, values, int(edge["_offset"]))).drop(columns="_span")

    return per_span(rows, starts, keys, run, schema_of(df, [c for c in df.columns if c not in out], **out))


def wilder_maps(x: np.ndarray, n: int, offset: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The mean of ``n`` values from bar ``first`` on, then (before*(n-1) + x)/n."""
    at = offset + np.arange(len(x))
    return np.where(at < first, 0.0, np.where(at < first + n, 1.0, (n - 1) / n)), np.where(at < first, 0.0, x / n)


def mean_maps(x: np.ndarray, alpha: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """An exponential mean, seeded with the first value."""
    a, b = np.full(len(x), 1 - alpha), alpha * x
    if offset == 0 and len(x):
        a[0], b[0] = 0.0, x[0]
    return a, b


def unseeded(x: np.ndarray, offset: int, bars: int, fill: float | None = None):
    """Values with ``fill`` (None: null) on a series' first ``bars`` bars and for NaN."""
    return pd.array([fill if i < bars or v != v else v for i, v in enumerate(x.tolist(), offset)], dtype="Float64")


def spaced(alerts: DataFrame, seconds: float, keys: Sequence[str] = ("event_key",), order: str = "alert_id", days: float = 7) -> DataFrame:
    """``passed`` of each row: none of its key passed within the last ``seconds``.

    The successor of a row is the first one ``seconds`` or more after it; what
    passes is the chain of successors from a key's first row. A span's rows are
    condensed first: the chain can enter it only at a row of its first ``seconds``
    or at the first one after them, and each such entry leads to one entry of a
    later span. Doubling the steps over entries (pointer jumping) finds the
    entries on the chain; then every span follows its own part of it.

    Of equal times the row that is first by ``order`` passes. Rows without a time
    do not pass and hold nothing up.
    """
    if seconds > 86400 * days:
        raise ValueError("a span must be longer than the spacing")
    length, wait = round(86400e6 * days), round(seconds * 1e6)
    own = [*keys, "_span"]
    span_of = lambda t: F.floor(F.col(t) / F.lit(length)).alias("_span")
    timed = alerts.drop("passed").withColumn("_t", F.unix_micros(F.col(TS).cast("timestamp")))
    rows = timed.select("*", span_of("_t")).repartition(*own)

    def condense(group: pd.DataFrame) -> pd.DataFrame:
        t = np.unique(group["_t"].to_numpy(np.int64))
        border = int(group["_span"].iloc[0]) * length + wait
        entry = t[: np.searchsorted(t, border) + 1]
        at, leave = np.arange(len(entry)), entry.copy()
        while len(at):
            following = np.searchsorted(t, leave[at] + wait)
            at, following = at[following < len(t)], following[following < len(t)]
            leave[at] = t[following]
        return pd.DataFrame({k: [group[k].iloc[0]] * len(entry) for k in own} | {"_entry": entry, "_free": leave + wait})

    entries = rows.where("_t is not null").select(*own, "_t").groupBy(*own).applyInPandas(condense, schema_of(rows, own, _entry="long", _free="long"))
    entries = stored(entries, "entries")  # each with the time from which the next may pass
    ahead = Window.partitionBy(*keys).orderBy("_span")
    spans = entries.groupBy(*own).agg(F.min("_entry").alias("_first"))
    spans = spans.select(*own, "_first", F.lead("_span").over(ahead).alias("_then"), F.lead("_first").over(ahead).alias("_to"), F.lead("_first", 2).over(ahead).alias("_else"))
    left = same_keys(entries, spans.drop("_first"), own).where("_to is not null")
    # the next span's first entry, or if that is too early, the next one in that span or the first of the span after
    early = left.where("_to < _free").select(*keys, F.col("_then").alias("_span"), F.col("_free").alias("_at"), F.col("_entry").alias("_from"), "_else")
    marks = entries.select(*own, F.col("_entry").alias("_at"), F.lit(None).cast("long").alias("_from"), F.lit(None).cast("long").alias("_else"))
    onward = Window.partitionBy(*own).orderBy("_at").rangeBetween(0, Window.unboundedFollowing)
    sought = early.unionByName(marks).withColumn("_to", F.min(F.when(F.col("_from").isNull(), F.col("_at"))).over(onward)).where("_from is not null")
    jump = left.where("_to >= _free").select(*keys, F.col("_entry").alias("_from"), "_to")
    jump = jump.unionByName(sought.select(*keys, "_from", F.coalesce("_to", "_else").alias("_to")).where("_to is not null"))
    jump, chain = stored(jump, "jump"), stored(spans.groupBy(*keys).agg(F.min("_first").alias("_entry")), "chain")
    while not jump.isEmpty():
        on = jump.select(*keys, F.col("_from").alias("_entry"), "_to")
        met = same_keys(chain, on, [*keys, "_entry"]).select(*keys, F.col("_to").alias("_entry"))
        chain = stored(chain.unionByName(met), "chain")
        twice = same_keys(jump, jump.select(*keys, F.col("_from").alias("_to"), F.col("_to").alias("_far")), [*keys, "_to"])
        jump = stored(twice.select(*keys, "_from", F.col("_far").alias("_to")), "jump")

    def follow(group: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_t", order], kind="stable").reset_index(drop=True)
        passed = np.zeros(len(group), bool)
        if len(entry) and len(group):
            t = group["_t"].to_numpy(np.int64)
            at = np.searchsorted(t, int(entry["_entry"].iloc[0]))
            while at < len(t):
                passed[at] = True
                at = np.searchsorted(t, t[at] + wait)
        return group.drop(columns=["_t", "_span"]).assign(passed=passed)

    entered = chain.select(*keys, span_of("_entry"), "_entry")
    return rows.groupBy(*own).cogroup(renewed(entered).groupBy(*own)).applyInPandas(follow, schema_of(alerts, [c for c in alerts.columns if c != "passed"], passed="boolean"))
