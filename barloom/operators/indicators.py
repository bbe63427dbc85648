"""Causal indicators of bars: trailing windows and recurrences.

Window indicators are plain column expressions over one partitioning. The
recurrences (EMA, Wilder averages) are scans over spans of each series; the
Wilder averages of ranges and directions are 0 until their seed. All are
causal: a row depends on earlier rows of its own series only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.spans import DAYS
from barloom.functions.windows import SERIES, TS, gated, ordered, trailing
from barloom.operators.scans import affine_scan, mean_maps, unseeded, wilder_maps

FEATURES = ("ret_1", "ret_5", "ret_20", "realized_vol", "vol_ratio", "volume_z", "volume_trend", "adx", "sma_slope", "rsi", "dist_sma", "roc_10", "roc_20", "natr")


# --- windows ----------------------------------------------------------------


def log_return(p: int, price: str = "close") -> Column:
    return F.log(F.try_divide(F.col(price), F.lag(price, p).over(ordered())))


def roc(p: int, price: str = "close") -> Column:
    return 100 * (F.try_divide(F.col(price), F.lag(price, p).over(ordered())) - 1)


def sma(rows: int, column: str = "close") -> Column:
    return gated(F.avg, column, rows)


def vol_ratio(column: str = "ret_1", short: int = 5, long: int = 20) -> Column:
    return F.try_divide(gated(F.stddev_samp, column, short), gated(F.stddev_samp, column, long))


def z_score(column: str, rows: int) -> Column:
    """(x - mean) / sample deviation over the last rows; null where it is 0."""
    deviation = gated(F.stddev_samp, column, rows)
    return F.when(deviation > 0, (F.col(column) - gated(F.avg, column, rows)) / deviation)


def slope(column: str, rows: int, bar_no: str = "bar_no") -> Column:
    """Least-squares slope per bar; ``bar_no`` numbers the bars of a series."""
    frame = trailing(rows)
    return F.when(F.count(column).over(frame) == rows, F.regr_slope(F.col(column), F.col(bar_no).cast("double")).over(frame))


def with_bar_no(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(ordered()))


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def asset_return(price: str = "close") -> Column:
    return F.coalesce(F.try_divide(F.col(price), F.lag(price).over(ordered())) - 1, F.lit(0.0))


def volume_trend(bars: DataFrame, rows: int = 10) -> DataFrame:
    """Slope of the volume's moving average: null for the first 2*rows - 2 bars."""
    bars = with_bar_no(bars).withColumn("_sma", sma(rows, "volume"))
    return bars.withColumn("volume_trend", slope("_sma", rows)).drop("_sma")


def sma_slope(bars: DataFrame, rows: int = 50) -> DataFrame:
    bars = with_bar_no(bars).withColumn("_sma", sma(rows))
    return bars.withColumn("sma_slope", slope("_sma", rows)).drop("_sma")


def dist_sma(rows: int = 200) -> Column:
    """(close - average) / close."""
    return F.try_divide(F.col("close") - sma(rows), F.col("close"))


# --- folds ------------------------------------------------------------------


def ordered_fold(df: DataFrame, fold: Callable[[pd.DataFrame], dict[str, np.ndarray]], out: dict[str, str], keys: tuple[str, ...] = (SERIES,), order: tuple[str, ...] = (TS,), drop: bool = True) -> DataFrame:
    """Add columns that a recurrence gives over each group in order. Without
    ``drop``, ``fold`` may read the columns that it replaces.

    ``fold`` gets a group's rows in order and returns the new columns. A group
    is one series (with its scenario or parameter): it must fit a worker.
    """
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n not in out), *(f"`{n}` {t}" for n, t in out.items())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(order), kind="stable").reset_index(drop=True)
        return group.assign(**fold(group))

    return (df.drop(*out) if drop else df).groupBy(*keys).applyInPandas(run, schema)


HLC = ("high", "low", "close")


def moves(bars: pd.DataFrame, before: np.ndarray | None) -> dict[str, np.ndarray]:
    """True ranges, directional moves and changes of each bar; ``before`` has high,
    low and close of the bar ahead (None: the first bar has no moves)."""
    high, low, close = (bars[c].to_numpy(float) for c in HLC)
    if before is None:
        before = np.array([high[0], low[0], np.nan])
    ahead = [np.concatenate([before[i : i + 1], x[:-1]]) for i, x in enumerate((high, low, close))]
    rise, fall = high - ahead[0], ahead[1] - low
    return {
        "range": np.fmax(high - low, np.fmax(np.abs(high - ahead[2]), np.abs(low - ahead[2]))),
        "plus": np.where((rise > fall) & (rise > 0), rise, 0.0),
        "minus": np.where((fall > rise) & (fall > 0), fall, 0.0),
        "change": np.nan_to_num(close - ahead[2]),
    }


def add_ema(bars: DataFrame, span: int = 50, column: str = "close", out: str = "ema", days: float = DAYS) -> DataFrame:
    """Exponential mean with alpha = 2 / (span + 1), seeded with the first value."""
    maps = lambda g, offset, _: {"ema": mean_maps(g[column].to_numpy(float), 2.0 / (span + 1), offset)}
    return affine_scan(bars, maps, lambda g, v, _: {out: v["ema"]}, {out: "double"}, (), days=days)


def add_atr(bars: DataFrame, n: int = 14, warmup: float | None = 0.0, days: float = DAYS) -> DataFrame:
    """Average true range; ``warmup`` (None: null) stands on the bars before its seed."""
    maps = lambda g, offset, before: {"atr": wilder_maps(moves(g, before)["range"], n, offset)}
    return affine_scan(bars, maps, lambda g, v, offset: {"atr": unseeded(v["atr"], offset, n - 1, warmup)}, {"atr": "double"}, HLC, days=days)


def average_maps(g: pd.DataFrame, offset: int, before: np.ndarray | None, n: int = 14, span: int = 50) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Averages of prices, ranges, moves and changes, as affine maps by name."""
    m = moves(g, before)
    kept = {"ema": mean_maps(g["close"].to_numpy(float), 2.0 / (span + 1), offset), "atr": wilder_maps(m["range"], n, offset)}
    kept |= {"up": mean_maps(np.maximum(m["change"], 0.0), 1 / n, offset), "down": mean_maps(np.maximum(-m["change"], 0.0), 1 / n, offset)}
    return kept | {k: wilder_maps(m[k], n, offset, 1) for k in ("range", "plus", "minus")}


def strength_and_direction(v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rsi, directional index) of the averages, warm-up included."""
    total = v["plus"] + v["minus"]
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(v["down"] == 0, 100.0, 100 - 100 / (1 + v["up"] / v["down"]))
        return rsi, np.where((v["range"] > 0) & (total > 0), 100 * np.abs(v["plus"] - v["minus"]) / total, 0.0)


def add_recurrences(bars: DataFrame, n: int = 14, span: int = 50, warmup: float | None = 0.0, days: float = DAYS) -> DataFrame:
    """ema, atr, rsi and adx. ``warmup`` stands for atr and adx before their seeds;
    rsi is null there.

    Two scans over spans of each series: the averages of prices, ranges, moves
    and changes, and then the average of the directional index that they give.
    """

    def indices(g: pd.DataFrame, v: dict[str, np.ndarray], offset: int) -> dict:
        rsi, dx = strength_and_direction(v)
        return {"ema": v["ema"], "atr": unseeded(v["atr"], offset, n - 1, warmup), "rsi": unseeded(rsi, offset, n - 1), "adx": dx}

    maps = lambda g, offset, before: average_maps(g, offset, before, n, span)
    once = affine_scan(bars, maps, indices, dict.fromkeys(("ema", "atr", "rsi", "adx"), "double"), HLC, days=days)
    again = once.withColumnRenamed("adx", "_dx")
    smooth = lambda g, offset, _: {"adx": wilder_maps(g["_dx"].to_numpy(float), n, offset, n)}
    done = affine_scan(again, smooth, lambda g, v, offset: {"adx": unseeded(v["adx"], offset, 2 * n - 1, warmup)}, {"adx": "double"}, (), days=days)
    return done.drop("_dx")


def _null(x: np.ndarray, fill: float | None = None):
    return pd.array([fill if np.isnan(v) else v for v in x], dtype="Float64")


# --- the feature matrix -----------------------------------------------------


def feature_matrix(bars: DataFrame) -> DataFrame:
    """The 14 features in their fixed order: one fold pass, then windows of one sort."""
    df = with_bar_no(add_recurrences(bars))
    df = df.withColumns({"ret_1": log_return(1), "ret_5": log_return(5), "ret_20": log_return(20), "volume_z": z_score("volume", 50), "_v": sma(10, "volume"), "_s": sma(50), "dist_sma": dist_sma(200), "roc_10": roc(10), "roc_20": roc(20), "natr": F.try_divide(F.col("atr"), F.col("close"))})
    df = df.withColumns({"realized_vol": gated(F.stddev_samp, "ret_1", 20), "vol_ratio": vol_ratio(), "volume_trend": slope("_v", 10), "sma_slope": slope("_s", 50)})
    return df.select("series_id", "ts", "open", "high", "low", "close", "volume", "ema", "atr", *FEATURES)


def rolling_z(x: np.ndarray, rows: int, block: int = 8192) -> np.ndarray:
    """``z_score`` of an array; frames are views, taken a block at a time."""
    out = np.full(len(x), np.nan)
    if len(x) >= rows:
        frames = np.lib.stride_tricks.sliding_window_view(x, rows)
        for i in range(0, len(frames), block):
            part = frames[i : i + block]
            deviation = part.std(axis=1, ddof=1)
            here = slice(i + rows - 1, i + rows - 1 + len(part))
            with np.errstate(divide="ignore", invalid="ignore"):
                out[here] = np.where(deviation > 0, (x[here] - part.mean(axis=1)) / deviation, np.nan)
    return out


def standardised_features(bars: DataFrame, rows: int = 252) -> DataFrame:
    """Rolling z-scores of all features, rows with a null dropped (warm-up).

    The scores are taken in one fold over the series, which its windows have left
    on one partition: long sliding frames cost a window its whole frame at every row.
    """
    df = feature_matrix(bars).select("series_id", "ts", "close", "ema", "atr", *FEATURES)
    scored = ordered_fold(df, lambda g: {c: _null(rolling_z(g[c].to_numpy(float, na_value=np.nan), rows)) for c in FEATURES}, dict.fromkeys(FEATURES, "double"), drop=False)
    return scored.na.drop()


def is_trending(adx: DataFrame, least: float = 25.0) -> DataFrame:
    """Whether the latest known ADX of a series reaches ``least``; false without one."""
    last = adx.groupBy(SERIES).agg(F.max_by("adx", F.when(F.col("adx").isNotNull(), F.col(TS))).alias("adx"))
    return last.select(SERIES, (F.coalesce("adx", F.lit(0.0)) >= least).alias("is_trending"))


def audit_lookahead(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] = FEATURES, tolerance: float = 1e-9) -> DataFrame:
    """(series_id, column) whose value at a probe row changes when later rows are
    hidden. The probe is each series' middle bar."""
    counted = with_bar_no(bars).withColumn("_n", F.count("*").over(Window.partitionBy(SERIES)))
    probe = counted.where(F.col("bar_no") == F.floor(F.col("_n") / 2) + 1).select(SERIES, F.col(TS).alias("probe"))
    prefix = bars.join(probe.hint("shuffle_hash"), SERIES).where(F.col(TS) <= F.col("probe")).drop("probe")
    long = lambda df, name: df.join(probe.hint("shuffle_hash"), SERIES).where(F.col(TS) == F.col("probe")).select(SERIES, F.explode(F.create_map(*[v for c in columns for v in (F.lit(c), F.col(c))])).alias("column", name))
    both = long(compute(prefix), "seen").join(long(compute(bars), "full").hint("shuffle_hash"), [SERIES, "column"], "full_outer")
    agree = F.col("seen").eqNullSafe(F.col("full")) | F.coalesce(F.abs(F.col("seen") - F.col("full")) <= tolerance, F.lit(False))
    return both.where(~agree)
