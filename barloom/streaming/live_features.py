"""The fourteen features and the regime of each new bar of a stream.

A series' state is what the next bar needs and no more: its last 764 bars (a
list that is trimmed), the carried values of the recurrences, its last 251 rows
of raw features, and the filter's last probabilities. Nothing is recomputed from
the start, and the rows equal those of the batch on the same history. State and
model of a series begin from a row of ``warm_state``; a series that is idle for
longer than the time to live loses its state and begins cold.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
Bars of a series must come in time order over the batches: a micro-batch is
sorted, and bars at or before the last one held are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.spans import renewed
from barloom.operators.indicators import FEATURES, HLC, average_maps, rolling_z, strength_and_direction
from barloom.operators.regimes import forward, log_emission, unpack
from barloom.operators.scans import steps, wilder_maps

BARS, Z_ROWS, FLICKER, CONFIRM = 764, 252, 20, 3
OHLCV = ("open", "high", "low", "close", "volume")
AVERAGES = ("ema", "atr", "up", "down", "range", "plus", "minus", "adx")
BAR = "us long, " + ", ".join(f"{c} double" for c in OHLCV)
HELD = "n long, averages array<double>, features array<double>, alpha array<double>, states array<int>, run long"
MODEL = "startprob array<double>, transmat array<array<double>>, means array<array<double>>, covars array<array<array<double>>>"
OUT = "series_id string, ts timestamp, " + ", ".join(f"{c} double" for c in FEATURES) + ", state_id int, probability double, consecutive_bars long, is_confirmed boolean, flicker long"
COLD = (0, [0.0] * len(AVERAGES), [], [], [], 0)
names = lambda schema: [c.split()[0] for c in schema.split(", ")]


def rolled(x: np.ndarray, rows: int, stat) -> np.ndarray:
    """``stat`` of each full window of ``rows`` values; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) >= rows:
        out[rows - 1 :] = stat(np.lib.stride_tricks.sliding_window_view(x, rows))
    return out


def window_features(bars: pd.DataFrame) -> dict[str, np.ndarray]:
    """The features that look back over a limited number of bars."""
    close, volume = bars["close"].to_numpy(float), bars["volume"].to_numpy(float)
    past = lambda p: np.concatenate([np.full(min(p, len(close)), np.nan), close[:-p]])
    mean, deviation = (lambda w: w.mean(axis=1)), (lambda w: w.std(axis=1, ddof=1))
    slope = lambda rows: (lambda w: w @ (np.arange(rows) - (rows - 1) / 2) / (rows * (rows**2 - 1) / 12))
    with np.errstate(divide="ignore", invalid="ignore"):
        ret = {p: np.log(close / past(p)) for p in (1, 5, 20)}
        long = rolled(ret[1], 20, deviation)
        return {
            **{f"ret_{p}": v for p, v in ret.items()},
            "realized_vol": long,
            "vol_ratio": np.where(long != 0, rolled(ret[1], 5, deviation) / long, np.nan),
            "volume_z": rolling_z(volume, 50),
            "volume_trend": rolled(rolled(volume, 10, mean), 10, slope(10)),
            "sma_slope": rolled(rolled(close, 50, mean), 50, slope(50)),
            "dist_sma": (close - rolled(close, 200, mean)) / close,
            **{f"roc_{p}": 100 * (close / past(p) - 1) for p in (10, 20)},
        }


def advance(held: pd.DataFrame, state: tuple, new: pd.DataFrame, model: tuple | None) -> tuple[pd.DataFrame, tuple, pd.DataFrame]:
    """(bars to hold, state after, a row for each new bar)."""
    n, carried, past, alpha, states, run = state
    count = len(new)
    every = pd.concat([held, new], ignore_index=True) if len(held) else new
    before = None if held.empty else held[list(HLC)].to_numpy(float)[-1]
    maps = average_maps(new, n, before)
    values = {k: steps(*maps[k], v) for k, v in zip(AVERAGES, carried) if k in maps}
    rsi, dx = strength_and_direction(values)
    values["adx"] = steps(*wilder_maps(dx, 14, n, 14), carried[-1])
    at = n + np.arange(count)
    raw = {k: v[len(held) :] for k, v in window_features(every).items()}
    raw |= {"adx": np.where(at < 27, 0.0, values["adx"]), "rsi": np.where(at < 13, np.nan, rsi), "natr": np.where(at < 13, 0.0, values["atr"]) / new["close"].to_numpy(float)}
    earlier = np.array(past, float).reshape(-1, len(FEATURES))
    table = np.concatenate([earlier, np.column_stack([raw[c] for c in FEATURES])])
    scores = np.column_stack([rolling_z(np.ascontiguousarray(table[:, i]), Z_ROWS)[len(earlier) :] for i in range(len(FEATURES))])
    out = pd.DataFrame(scores, columns=list(FEATURES))
    found = {"state_id": pd.array([None] * count, "Int32"), "probability": pd.array([None] * count, "Float64"), "consecutive_bars": pd.array([None] * count, "Int64"), "is_confirmed": np.zeros(count, bool), "flicker": pd.array([None] * count, "Int64")}
    whole = np.flatnonzero(~np.isnan(scores).any(axis=1))
    if model is not None and len(whole):
        start, transition, means, covars = model
        with np.errstate(divide="ignore"):
            last = np.log(np.array(alpha)) if len(alpha) else None
        p = np.exp(forward(log_emission(scores[whole], means, covars), start, transition, last)[0])
        for i, row in zip(whole.tolist(), p):
            s = int(row.argmax())
            run = run + 1 if states and states[-1] == s else 1
            states = [*states, s][-FLICKER:]
            for k, v in (("state_id", s), ("probability", float(row.max())), ("consecutive_bars", run), ("is_confirmed", run >= CONFIRM), ("flicker", sum(a != b for a, b in zip(states, states[1:])))):
                found[k][i] = v
        alpha = p[-1].tolist()
    after = (n + count, [float(values[k][-1]) for k in AVERAGES], table[-(Z_ROWS - 1) :].ravel().tolist(), list(alpha), [int(s) for s in states], int(run))
    return every.iloc[-BARS:], after, out.assign(**found)


def bar_frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=names(BAR))


def warm_state(history: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each series to begin a stream from: its model (null: none) and its
    state after ``history``. Series without history begin cold."""

    def run(bars: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        key = (bars if len(bars) else model)["series_id"].iloc[0]
        params = None if model.empty else unpack(model.iloc[0])
        held, state = bar_frame([]), COLD
        if len(bars):
            held, state, _ = advance(held, state, bars.sort_values("us")[names(BAR)].reset_index(drop=True), params)
        row = {"series_id": [key], "bars": [held.to_numpy(float).ravel().tolist()], "last_us": [int(held["us"].iloc[-1]) if len(held) else None]}
        row |= {k: [v] for k, v in zip(names(HELD), state)} | {k: [v if v is None else v.tolist()] for k, v in zip(names(MODEL), params or (None,) * 4)}
        return pd.DataFrame(row)

    bars = history.select("series_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *[F.col(c).cast("double").alias(c) for c in OHLCV])
    known = renewed(models.select("series_id", *names(MODEL)))
    return bars.groupBy("series_id").cogroup(known.groupBy("series_id")).applyInPandas(run, f"series_id string, bars array<double>, last_us long, {HELD}, {MODEL}")


class LiveFeatures(StatefulProcessor):
    """State: ``bars`` (the rolling buffer), ``held`` and ``model``."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", BAR, self.ttl_ms)
        self.held = handle.getValueState("held", HELD, self.ttl_ms)
        self.model = handle.getValueState("model", MODEL)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        if row["startprob"] is not None:
            self.model.update(tuple(x.tolist() for x in unpack(row)))
        if row["last_us"] is not None and not pd.isna(row["last_us"]):
            flat = np.array(row["bars"], float).reshape(-1, 1 + len(OHLCV))
            self.bars.put([(int(b[0]), *map(float, b[1:])) for b in flat])
            self.held.update((int(row["n"]), [float(v) for v in row["averages"]], [float(v) for v in row["features"]], [float(v) for v in row["alpha"]], [int(v) for v in row["states"]], int(row["run"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else COLD
        held = bar_frame(self.bars.get() if self.bars.exists() and state is not COLD else [])
        state = state if len(held) else COLD  # both live and expire together
        new = pd.concat(list(rows)).sort_values("us", kind="stable").drop_duplicates("us")
        if len(held):
            new = new[new["us"] > held["us"].iloc[-1]]
        if new.empty:
            return
        new = new[names(BAR)].reset_index(drop=True)
        model = unpack(pd.Series(dict(zip(names(MODEL), self.model.get())))) if self.model.exists() else None
        held, state, out = advance(held, state, new, model)
        self.bars.put([(int(r[0]), *map(float, r[1:])) for r in held.itertuples(index=False)])
        self.held.update(state)
        out.insert(0, "ts", pd.to_datetime(new["us"], unit="us"))
        out.insert(0, "series_id", key[0])
        yield out

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame, warm: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Standardised features of each new bar (null in warm-up) and, for series with a
    model in ``warm``, its state, probability, run and flicker."""
    rows = bars.select("series_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *[F.col(c).cast("double").alias(c) for c in OHLCV])
    begin = None if warm is None else warm.groupBy("series_id")
    return rows.groupBy("series_id").transformWithStateInPandas(LiveFeatures(ttl_ms), OUT, "Append", "None" if ttl_ms is None else "ProcessingTime", begin)
