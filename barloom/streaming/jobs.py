"""Structured Streaming versions of the stateful operators.

``stream_bars`` bounds its state by a watermark; rows later than that are dropped
and counted by Spark. ``stream_rate_limit``, ``stream_ledger`` and ``stream_breaker``
do so too if they are given a lateness: rows then wait for the watermark and are
applied in the order of their times, and state that no row can need is dropped.
Without one, rows come out at once: these and the other jobs keep a small state for
each key for as long as the query runs (a last time, a running position, a trimmed
buffer), need a key's rows in time order and sort those of one micro-batch. All take
its rows of a key as one frame, so a trigger's size must be limited at the source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.risk import HALTED, NORMAL, REDUCED
from barloom.sources.bars import WIDTHS, with_mid_and_spread
from barloom.streaming.ordered import fold_in_order


def stream_bars(ticks: DataFrame, width: str = "1m", lateness: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a tick stream, each emitted once, when it is complete."""
    span = F.window("ts", WIDTHS.get(width, "1 day"))
    bars = ticks.withWatermark("ts", lateness).groupBy("series_id", span.alias("w")).agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume"))
    return bars.select("series_id", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_spread_filter(quotes: DataFrame, most: float = 0.005) -> DataFrame:
    """Quotes whose spread is within bounds: no state."""
    return with_mid_and_spread(quotes).where(F.col("spread_pct") <= most)


def stream_rate_limit(alerts: DataFrame, minutes: float = 15.0, lateness: str | None = None) -> DataFrame:
    """Alerts that pass: none of their key passed within the last minutes.

    With a ``lateness`` alerts wait for the watermark and pass in the order of their
    times; a key's state goes once its last alert can hold back no other.
    """

    def apply(last: int | None, us: list[int]) -> tuple[int | None, list[int]]:
        kept = []
        for i, t in enumerate(us):
            if last is None or t - last >= minutes * 60_000_000:
                kept.append(i)
                last = t
        return last, kept

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "alert_id"])
        last, kept = apply(state.get[0] if state.exists else None, rows["ts"].astype("datetime64[us]").astype("int64").tolist())
        if last is not None:
            state.update((int(last),))
        yield rows.iloc[kept]

    def ordered(carried: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        last, kept = apply(carried[0] if carried else None, rows["us"].tolist())
        return (int(last),), rows.iloc[kept][["us", "alert_id"]]

    shaped = alerts.select("event_key", "ts", "alert_id")
    if lateness is not None:
        passed = fold_in_order(shaped, ("event_key",), ordered, "passed_us long", "us long, alert_id long", ("alert_id",), lateness, minutes * 60)
        return passed.select("event_key", F.timestamp_micros("us").alias("ts"), "alert_id")
    return shaped.groupBy("event_key").applyInPandasWithState(step, "event_key string, ts timestamp, alert_id long", "last_us long", "append", GroupStateTimeout.NoTimeout)


def stream_ledger(fills: DataFrame, lateness: str | None = None) -> DataFrame:
    """Average-cost positions of a fill stream: quantity, price and realised result.

    With a ``lateness`` fills wait for the watermark and are booked in the order of
    their times; only open positions have state.
    """
    names = ["held", "avg_price", "realized"]

    def apply(held: float, avg: float, rows: pd.DataFrame) -> tuple[tuple[float, float], pd.DataFrame]:
        out = []
        for side, qty, price in zip(rows["side"], rows["qty"], rows["price"], strict=True):
            made = 0.0
            if side == "buy":
                avg = (held * avg + qty * price) / (held + qty)
                held += qty
            elif held > 0:
                closed = min(qty, held)
                made = (price - avg) * closed
                held -= closed
                if held <= 1e-9:
                    held, avg = 0.0, 0.0
            out.append((held, avg, made))
        return (float(held), float(avg)), pd.DataFrame(out, columns=names, dtype=float)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "fill_id"]).reset_index(drop=True)
        after, out = apply(*(state.get if state.exists else (0.0, 0.0)), rows)
        state.update(after)
        yield rows[["series_id", "fill_id"]].assign(**out)

    def ordered(carried: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        after, out = apply(*(carried or (0.0, 0.0)), rows)
        return after if after[0] > 0 else None, rows[["fill_id"]].assign(**out)

    booked = "fill_id string, held double, avg_price double, realized double"
    if lateness is not None:
        shaped = fills.select("series_id", "ts", "fill_id", "side", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
        return fold_in_order(shaped, ("series_id",), ordered, "held double, avg_price double", booked, ("fill_id",), lateness)
    return fills.groupBy("series_id").applyInPandasWithState(step, f"series_id string, {booked}", "held double, avg_price double", "append", GroupStateTimeout.NoTimeout)


def stream_breaker(equity: DataFrame, lateness: str | None = None, idle_seconds: float | None = None) -> DataFrame:
    """Latched posture of each bar of an equity stream (series_id, ts, ret, equity).

    The day's and the ISO week's latch start anew before the first bar of a day
    or week is applied; the peak's latch stays. With a ``lateness`` bars wait for
    the watermark and are applied in the order of their times; state of a series
    then goes ``idle_seconds`` of event time after its last bar, if that is given.
    """
    level = lambda x, reduce, halt: HALTED if x <= -halt else REDUCED if x <= -reduce else NORMAL

    def apply(carried: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[int]]:
        day, week, daily, weekly, day_latch, week_latch, peak, peak_latch = carried or (0, 0, 1.0, 1.0, NORMAL, NORMAL, float("-inf"), NORMAL)
        severity = []
        for today, this, ret, now in zip(rows["day"], rows["week"], rows["ret"], rows["equity"], strict=True):
            if today != day:
                day, daily, day_latch = today, 1.0, NORMAL
            if this != week:
                week, weekly, week_latch = this, 1.0, NORMAL
            daily, weekly, peak = daily * (1 + ret), weekly * (1 + ret), max(peak, now)
            day_latch = max(day_latch, level(daily - 1, 0.02, 0.03))
            week_latch = max(week_latch, level(weekly - 1, 0.05, 0.07))
            peak_latch = max(peak_latch, HALTED if (peak - now) / peak >= 0.10 else NORMAL)
            severity.append(max(day_latch, week_latch, peak_latch))
        return (int(day), int(week), float(daily), float(weekly), int(day_latch), int(week_latch), float(peak), int(peak_latch)), severity

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        after, severity = apply(state.get if state.exists else None, rows)
        state.update(after)
        yield rows[["series_id", "ts"]].assign(severity=pd.Series(severity, index=rows.index, dtype="int32"))

    def ordered(carried: tuple | None, rows: pd.DataFrame) -> tuple[tuple | None, pd.DataFrame]:
        after, severity = apply(carried, rows)
        return after, rows[["us"]].assign(severity=pd.Series(severity, index=rows.index, dtype="int32"))

    held = "day long, week long, daily double, weekly double, day_latch int, week_latch int, peak double, peak_latch int"
    date = F.col("ts").cast("date")
    week = F.extract(F.lit("YEAROFWEEK"), date).cast("long") * 100 + F.weekofyear(date)
    shaped = equity.select("series_id", "ts", "ret", "equity", F.unix_date(date).cast("long").alias("day"), week.alias("week"))
    if lateness is not None:
        latched = fold_in_order(shaped, ("series_id",), ordered, held, "us long, severity int", (), lateness, idle_seconds)
        return latched.select("series_id", F.timestamp_micros("us").alias("ts"), "severity")
    return shaped.groupBy("series_id").applyInPandasWithState(step, "series_id string, ts timestamp, severity int", held, "append", GroupStateTimeout.NoTimeout)


def stream_rolling_mean(bars: DataFrame, rows: int = 764, column: str = "close") -> DataFrame:
    """Bars held and their mean, from a buffer of each series' last ``rows`` values."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [float(x) for x in state.get[0]] if state.exists else []
        got = pd.concat(list(batches)).sort_values("ts", kind="stable")
        every = pd.Series([*held, *got[column]], dtype=float)
        mean, size = every.rolling(rows, min_periods=1).mean(), every.rolling(rows, min_periods=1).count()
        state.update((every.iloc[-rows:].tolist(),))
        yield got[["series_id", "ts"]].assign(bars=size.iloc[len(held) :].astype("int32").to_numpy(), mean=mean.iloc[len(held) :].to_numpy())

    return bars.select("series_id", "ts", column).groupBy("series_id").applyInPandasWithState(step, "series_id string, ts timestamp, bars int, mean double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_staleness(ticks: DataFrame, seconds: float = 300.0, timer_ms: int | None = None) -> DataFrame:
    """Silences of a tick stream: kind ``gap`` for more than ``seconds`` between two
    ticks, kind ``stale`` once nothing has come for as long on the clock."""
    wait = int(timer_ms or seconds * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else pd.NaT
        if state.hasTimedOut:
            state.update(state.get)  # stays, without a timer: reported once
            yield pd.DataFrame({"series_id": [key[0]], "ts": [last], "silence": [wait / 1000], "kind": ["stale"]})
            return
        ts = pd.concat(list(batches))["ts"].sort_values(ignore_index=True)
        silence = (ts - ts.shift(fill_value=last)).dt.total_seconds()
        state.update((int(max(ts.iloc[-1], last if pd.notna(last) else ts.iloc[-1]).value // 1000),))
        state.setTimeoutDuration(wait)
        yield pd.DataFrame({"series_id": key[0], "ts": ts, "silence": silence, "kind": "gap"})[silence > seconds]

    return ticks.select("series_id", "ts").groupBy("series_id").applyInPandasWithState(step, "series_id string, ts timestamp, silence double, kind string", "last_us long", "append", GroupStateTimeout.ProcessingTimeTimeout)
