"""Series cut into spans of time, so that a long one is many groups.

A span's rows are one group; what a span needs from those before it (the rows
that stand there, the last row's values, a carried state) is a row of a small
table with one row for each span. Bars come at most once for each bar width, so
a span's rows are bounded by its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.windows import SERIES, TS

#: Days of a span: about eleven years of daily bars.
DAYS = 4096


def spanned(df: DataFrame, days: float = DAYS, keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """Rows with their span's number, dealt by series and span: the passes over
    the rows read this one exchange."""
    return df.withColumn("_span", F.floor(F.col(TS).cast("timestamp").cast("double") / (86400 * days))).repartition(*keys, "_span")


def span_edges(rows: DataFrame, columns: Sequence[str] = (), keys: Sequence[str] = (SERIES,)) -> DataFrame:
    """(_offset, _before, _last) of each span: the series' rows before it, the last
    of them as an array of ``columns`` (null: none), and whether no span follows."""
    last = F.max_by(F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>"), F.col(TS))
    spans = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n"), last.alias("_end"))
    order = Window.partitionBy(*keys).orderBy("_span")
    before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.select(*keys, "_span", F.coalesce(before, F.lit(0)).alias("_offset"), F.lag("_end").over(order).alias("_before"), F.lead("_span").over(order).isNull().alias("_last"))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls among them; ``right`` adds its other columns."""
    renamed = right.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in right.columns])
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    return left.join(renamed.hint("shuffle_hash"), equal, how).drop(*[f"_key_{c}" for c in keys])


def renewed(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, to stand beside a table that ``df`` came from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def per_span(rows: DataFrame, spans: DataFrame, keys: Sequence[str], step: Callable[[pd.DataFrame, pd.Series], pd.DataFrame | None], schema: str) -> DataFrame:
    """``step`` on the rows of each span in time order and the span's own row.
    Spans that ``spans`` lacks are left out."""

    def run(group: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        done = None if group.empty or span.empty else step(group.sort_values(TS, kind="stable").reset_index(drop=True), span.iloc[0])
        return pd.DataFrame() if done is None else done

    return rows.groupBy(*keys, "_span").cogroup(renewed(spans).groupBy(*keys, "_span")).applyInPandas(run, schema)


def followed(rows: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the spans after which another comes: only their effect is carried on."""
    own = [*keys, "_span"]
    return same_keys(rows, edges.where("not _last").select(*own), own, "left_semi")


def schema_of(df: DataFrame, columns: Sequence[str], **more: str) -> str:
    """The named columns of ``df`` and some others as a schema."""
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns if c not in more), *(f"`{c}` {t}" for c, t in more.items())])


def first_rows(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Where a group of sorted rows begins: the keys differ from the row ahead, which
    is ``before`` for the first (None: it begins). Nulls are equal, as are NaNs."""
    differ = np.zeros(batch.num_rows, bool)
    differ[0] = before is None
    for key in keys:
        own = batch.column(key)
        both = own if before is None else pa.concat_arrays([before.column(key), own])
        codes = pc.dictionary_encode(both, null_encoding="encode").indices.to_numpy()
        differ[len(own) + 1 - len(both) :] |= codes[1:] != codes[:-1]
    return differ
