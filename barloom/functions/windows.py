"""Window helpers for ordered series.

A trailing statistic is null until its frame is full: a partial frame never
gives a value. Every helper takes the same partitioning and order, so that a
whole set of them shares one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SERIES, TS = "series_id", "ts"


def ordered(keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def running(keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> WindowSpec:
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(rows: int, keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> WindowSpec:
    return ordered(keys, order).rowsBetween(-(rows - 1), Window.currentRow)


def gated(agg: Callable[[Column], Column], column: Column | str, rows: int, keys: Sequence[str] = (SERIES,)) -> Column:
    """``agg`` over the last ``rows`` values; null while fewer are there."""
    column = F.col(column) if isinstance(column, str) else column
    frame = trailing(rows, keys)
    return F.when(F.count(column).over(frame) == rows, agg(column).over(frame))


def compounded(returns: Column, frame: WindowSpec) -> Column:
    """Product of (1 + r) over a frame, minus one."""
    return F.product(1 + returns).over(frame) - 1


def run_length(value: Column, keys: Sequence[str] = (SERIES,), order: Sequence[str] = (TS,)) -> tuple[Column, Column]:
    """(change flag, frame) of gaps-and-islands: sum the flag for an island number."""
    before = F.lag(value).over(ordered(keys, order))
    return F.when(before.isNull() | (before != value), 1).otherwise(0), running(keys, order)
