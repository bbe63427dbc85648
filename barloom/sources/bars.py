"""Sources: ticks, bars, quotes and snapshots of many series.

Schemas are fixed: ``ticks(series_id, ts, price, qty, *order)``,
``bars(series_id, ts, open, high, low, close, volume)``,
``quotes(series_id, ts, bid, ask)``. Readers prune columns and push ranges down
to the scan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OHLCV = ("open", "high", "low", "close", "volume")
#: Bar widths by name; any other name is a day.
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; timestamps without a zone are read in the session's."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*[F.col(f"`{n}`").cast("timestamp").alias(n) if kind == "timestamp_ntz" else F.col(f"`{n}`") for n, kind in df.dtypes])


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the three return flags: price, quantity, and a total order."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the event types: value as price, one unit each."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("qty"), F.struct("ts", "event_id").alias("seq"))


def load_bars(bars: DataFrame, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Bars in [start, end) of some symbols, without rows that hold a null."""
    if symbols is not None:
        bars = bars.where(F.col("series_id").isin(symbols))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return bars.select("series_id", "ts", *OHLCV).na.drop()


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The most recent n rows of each series."""
    latest = Window.partitionBy("series_id").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n")


def resample_bars(ticks: DataFrame, width: str = "1d") -> DataFrame:
    """Ticks to bars. Partial aggregates shrink a hot series before the shuffle."""
    start = F.window("ts", WIDTHS.get(width, "1 day"))["start"]
    return ticks.groupBy("series_id", start.alias("ts")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("qty").alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_bars(lineitem_ticks(spark, sf_dir), "1d")


def with_mid_and_spread(quotes: DataFrame) -> DataFrame:
    """mid is 0 where a side is absent; the spread is infinite where mid <= 0."""
    both = (F.coalesce("bid", F.lit(0.0)) > 0) & (F.coalesce("ask", F.lit(0.0)) > 0)
    mid = F.when(both, (F.col("bid") + F.col("ask")) / 2).otherwise(0.0)
    return quotes.withColumn("mid", mid).withColumn("spread_pct", F.when(F.col("mid") > 0, (F.col("ask") - F.col("bid")) / F.col("mid")).otherwise(F.lit(float("inf"))))


def latest_snapshot(trades: DataFrame, quotes: DataFrame, bars: DataFrame) -> DataFrame:
    """Last trade price, last bid and ask, last close by series; absent sides are 0."""
    last = trades.groupBy("series_id").agg(F.max_by("price", "seq").alias("price"))
    quote = quotes.groupBy("series_id").agg(F.max_by(F.struct("bid", "ask"), "ts").alias("q"))
    close = bars.groupBy("series_id").agg(F.max_by("close", "ts").alias("close"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    joined = last.join(quote.hint("shuffle_hash"), "series_id", "left").join(close.hint("shuffle_hash"), "series_id", "left")
    return joined.select("series_id", zero(F.col("price")).alias("price"), zero(F.col("q.bid")).alias("bid"), zero(F.col("q.ask")).alias("ask"), zero(F.col("close")).alias("daily_close"))


#: Broker words for an order's state and the state kept. Fixed values.
STATUS = {
    "new": "submitted",
    "accepted": "submitted",
    "pending_new": "pending",
    "accepted_for_bidding": "submitted",
    "filled": "filled",
    "partially_filled": "partially_filled",
    "canceled": "cancelled",
    "cancelled": "cancelled",
    "expired": "cancelled",
    "done_for_day": "cancelled",
    "rejected": "rejected",
    "suspended": "rejected",
}


def normalise_status(status: Column) -> Column:
    """Text after the last dot, lower-cased and looked up; anything else is pending."""
    word = F.lower(F.substring_index(status, ".", -1))
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, word), F.lit("pending"))


def order_history(orders: DataFrame, state: str = "all", limit: int | None = None) -> DataFrame:
    """Orders that are open, closed or all, newest first; null numbers are 0."""
    done = F.col("status").isin("filled", "cancelled", "rejected")
    if state != "all":
        orders = orders.where(done if state == "closed" else ~done)
    numbers = [n for n, kind in orders.dtypes if kind in ("double", "float", "int", "bigint") and n != "order_id"]
    orders = orders.select(*[F.coalesce(n, F.lit(0)).alias(n) if n in numbers else F.col(n) for n in orders.columns]).orderBy(F.desc("ts"), "order_id")
    return orders.limit(limit) if limit is not None else orders


def write_report(frames: dict[str, DataFrame], folder: str, kind: str = "parquet") -> list[str]:
    """Write equity_curve, trade_log, regime_history and, if there is one,
    benchmark_comparison, partitioned by series."""
    done = []
    for name in ("equity_curve", "trade_log", "regime_history", "benchmark_comparison"):
        frame = frames.get(name)
        if frame is None:
            if name != "benchmark_comparison":
                raise ValueError(f"the report lacks {name}")
            continue
        writer = frame.write.mode("overwrite").format(kind)
        (writer.partitionBy("series_id") if "series_id" in frame.columns else writer).option("header", True).save(f"{folder}/{name}")
        done.append(name)
    return done
