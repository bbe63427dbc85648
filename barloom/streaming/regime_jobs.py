"""Regime states of a bar stream, from cold or from history, and order de-duplication.

A series' state is what the next bar needs: its last returns, the filtered
probabilities, the last states and the run so far. Bars must come in time order
for each series; a micro-batch's own bars are sorted. State of a series is kept
for as long as the query runs, since its next bar may come at any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.regimes import forward, log_emission, unpack

ROWS, FLICKER, CONFIRM = 20, 20, 3
MODEL = ("startprob", "transmat", "means", "covars")
STATE = "held array<double>, alpha array<double>, states array<int>, run long"


def advance(state: tuple, ret: np.ndarray, model: tuple) -> tuple[tuple, pd.DataFrame]:
    """The state after some bars, and a row for each of them (null states in warm-up).

    Features are the return and its deviation over the last bars.
    """
    held, alpha, states, run = (list(v) if np.ndim(v) else v for v in state)
    start, transition, means, covars = model
    every = pd.Series([*held, *ret], dtype=float)
    vol = every.rolling(ROWS, min_periods=2).std().to_numpy()[len(held) :]
    known = ~np.isnan(vol)
    out = pd.DataFrame({"state_id": pd.array([None] * len(ret), "Int32"), "probability": np.nan, "consecutive_bars": pd.array([None] * len(ret), "Int64"), "is_confirmed": False, "flicker": pd.array([None] * len(ret), "Int64")})
    if known.any():
        x = np.column_stack([np.asarray(ret, float)[known], vol[known]])
        prior = np.array(alpha) @ transition if len(alpha) else start
        p = np.exp(forward(log_emission(x, means, covars), prior, transition)[0])
        runs, flickers = [], []
        for s in p.argmax(axis=1).tolist():
            run = run + 1 if states and states[-1] == s else 1
            states = [*states, s][-FLICKER:]
            runs.append(run)
            flickers.append(sum(a != b for a, b in zip(states, states[1:], strict=False)))
        out.loc[known, "state_id"], out.loc[known, "probability"] = p.argmax(axis=1), p.max(axis=1)
        out.loc[known, "consecutive_bars"], out.loc[known, "flicker"] = runs, flickers
        out.loc[known, "is_confirmed"] = np.array(runs) >= CONFIRM
        alpha = (p[-1] / p[-1].sum()).tolist()
    return (every.iloc[-(ROWS - 1) :].tolist(), alpha, states, int(run)), out


COLD = ([], [], [], 0)


def warm_start(history: DataFrame, models: DataFrame, column: str = "ret") -> DataFrame:
    """The state of each series after its history: a row to begin a stream from.
    Series without a model or without history have none."""

    def run(bars: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if bars.empty or model.empty:
            return pd.DataFrame({"series_id": [], "held": [], "alpha": [], "states": [], "run": []})
        state, _ = advance(COLD, bars.sort_values("ts")[column].to_numpy(float), unpack(model.iloc[0]))
        return pd.DataFrame({"series_id": [bars["series_id"].iloc[0]], **{k: [v] for k, v in zip(("held", "alpha", "states", "run"), state, strict=True)}})

    bars = history.select("series_id", "ts", column).groupBy("series_id")
    return bars.cogroup(models.select("series_id", *MODEL).groupBy("series_id")).applyInPandas(run, f"series_id string, {STATE}")


def stream_regimes(bars: DataFrame, models: DataFrame, warm: DataFrame | None = None, column: str = "ret") -> DataFrame:
    """State, run length and flicker of each new bar: one forward step, nothing recomputed.

    ``models`` and ``warm`` are static, a row for each series; bars of series
    without a model are left out, and series without a warm row start cold.
    """
    known = models.select("series_id", *MODEL)
    names = [f.split()[0] for f in STATE.split(", ")]
    if warm is not None:
        known = known.join(warm.select("series_id", *names).hint("shuffle_hash"), "series_id", "left")
    rows = bars.select("series_id", "ts", column).join(known.hint("shuffle_hash"), "series_id")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches)).sort_values("ts", kind="stable").reset_index(drop=True)
        first = got.iloc[0]
        begin = COLD
        if state.exists:
            begin = state.get
        elif first.get("alpha") is not None:  # no such column without warm rows
            begin = tuple(first[n] for n in names)
        after, out = advance(begin, got[column].to_numpy(float), unpack(first))
        held, alpha, states, run = after
        state.update(([float(v) for v in held], [float(v) for v in alpha], [int(v) for v in states], run))
        yield pd.concat([got[["series_id", "ts"]], out], axis=1)

    schema = "series_id string, ts timestamp, state_id int, probability double, consecutive_bars long, is_confirmed boolean, flicker long"
    return rows.groupBy("series_id").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_dedupe(orders: DataFrame, keys: tuple[str, ...], seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """(order_id, ts, is_duplicate) of an order stream: whether an order of the same
    keys came less than ``seconds`` before.

    The state of a key is its latest time; it is dropped when the watermark has
    passed it by ``seconds``. An order that is late, but not later than the
    watermark, counts as a duplicate of the key's latest if it is near it.
    """
    types = dict(orders.dtypes)
    parts = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "order_id"]).reset_index(drop=True)
        again = []
        for us in (rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
            again.append(last is not None and abs(us - last) < seconds * 1_000_000)
            last = us if last is None else max(last, us)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(is_duplicate=again)

    marked = orders.select(*keys, "ts", "order_id").withWatermark("ts", lateness)
    return marked.groupBy(*keys).applyInPandasWithState(step, f"{parts}, ts timestamp, order_id long, is_duplicate boolean", "last_us long", "append", GroupStateTimeout.EventTimeTimeout)
