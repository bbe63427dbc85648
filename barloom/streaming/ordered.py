"""Folds over a stream in the order of its times, whatever order rows come in.

A row waits in state until the watermark has passed its time; a timer then applies
all rows of its key that are due, in order. So rows that come late, but not later
than the watermark, give the same result as in the batch, and a key holds the rows
of the allowed lateness and what the fold carries, no more. Rows later than the
watermark are dropped and counted by Spark. A key whose fold carries nothing on,
or that has been idle for longer than it may be, has no state.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: (carried or None, rows in order) -> (carried on or None, output without the keys)
Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame]]


def plain(rows: pd.DataFrame) -> list[tuple]:
    """Rows as state takes them: Python's own values, None for nulls."""
    return [tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in rows.itertuples(index=False)]


class InOrder(StatefulProcessor):
    """State: ``pending`` rows, the ``carried`` values of the fold and, with them, the
    time of the last row applied."""

    def __init__(self, keys: Sequence[str], columns: Sequence[tuple[str, str]], carried: str, step: Step, order: Sequence[str], idle_ms: int | None):
        self.keys, self.columns, self.carry = list(keys), list(columns), carried
        self.step, self.order, self.idle_ms = step, list(order), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ", ".join(f"`{n}` {t}" for n, t in self.columns))
        self.carried = handle.getValueState("carried", "last_us long, " + self.carry)

    def _wake(self, at_ms: int) -> None:
        """One timer for each key."""
        for t in list(self.handle.listTimers()):
            if t == at_ms:
                return
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [n for n, _ in self.columns]
        first = min((int(r[0]) for r in self.pending.get()), default=None) if self.pending.exists() else None
        for part in rows:
            if len(part):
                self.pending.appendList(plain(part[names]))
                low = int(part["us"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(max(-(-first // 1000), timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.pending.get()) if self.pending.exists() else [], columns=[n for n, _ in self.columns])
        due = held["us"].astype("int64") <= now * 1000
        carried = tuple(self.carried.get()) if self.carried.exists() else None
        if due.any():
            rows = held[due].sort_values(["us", *self.order], kind="stable").reset_index(drop=True)
            after, out = self.step(carried[1:] if carried else None, rows)
            carried = None if after is None else (int(rows["us"].iloc[-1]), *after)
            for name, value in reversed(list(zip(self.keys, key))):
                out.insert(0, name, value)
            yield out
        rest = held[~due]
        if len(rest):
            self.pending.put(plain(rest))
            self._wake(-(-int(rest["us"].min()) // 1000))
        else:
            self.pending.clear()
        if carried is not None and not len(rest) and self.idle_ms is not None:
            until = -(-carried[0] // 1000) + self.idle_ms
            if until <= now:
                carried = None
            else:
                self._wake(until)
        if carried is None:
            self.carried.clear()
        else:
            self.carried.update(carried)

    def close(self) -> None:
        pass


def fold_in_order(stream: DataFrame, keys: Sequence[str], step: Step, carried: str, out: str, order: Sequence[str] = (), lateness: str = "10 minutes", idle_seconds: float | None = None) -> DataFrame:
    """Fold each key's rows of a stream (with ts) in the order of ts and ``order``.

    ``step`` gets the rows with ``us`` (microseconds of ts) first; ``out`` is the
    schema of what it returns, to which the keys are added. Rows without a time are
    left out; a null key is a key of its own. State of a key goes ``idle_seconds`` of
    event time after its last row, or with a step that carries on None.
    """
    types = dict(stream.dtypes)
    rest = [c for c in stream.columns if c not in (*keys, "ts")]
    rows = stream.where("ts is not null").withWatermark("ts", lateness)
    rows = rows.select(*keys, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *rest)
    columns = [("us", "long"), *((c, types[c]) for c in rest)]
    idle = None if idle_seconds is None else int(idle_seconds * 1000)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), out])
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(keys, columns, carried, step, order, idle), schema, "Append", "EventTime")
