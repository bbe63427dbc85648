"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset (tests, local mode) a folder of our own is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_barloom_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The folder goes when the application ends, or sooner with ``discard``.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _file_system(spark, path, lambda files, at: files.deleteOnExit(at))
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def discard(*frames: DataFrame) -> None:
    """Remove what ``written`` stored for frames that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "_written_at", None)
        if path:
            _file_system(frame.sparkSession, path, lambda files, at: files.delete(at, True))


def _file_system(spark: SparkSession, path: str, do) -> None:
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:  # a remote session removes its folder itself
        at = jvm.org.apache.hadoop.fs.Path(path)
        do(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def row_slices(batches: Iterator[pa.RecordBatch], text_field: str, max_chars: int = 4_000_000):
    """Cut Arrow batches so that each slice holds about ``max_chars`` of text.

    A single longer text is a slice of its own; no text is ever cut.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.binary_length(batch.column(text_field)).fill_null(0).to_pylist()
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > max_chars:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield batch.slice(begin)


def range_buckets(df: DataFrame, column: str, buckets: int) -> list:
    """Ascending inner bounds that cut ``column`` into about equal row counts.

    Only quantiles of the key reach the driver: ``buckets`` values at most.
    """
    if buckets < 2:
        return []
    steps = [i / buckets for i in range(1, buckets)]
    got = df.agg(F.percentile_approx(column, steps, 10 * buckets).alias("q")).first()["q"]
    return sorted(set(got or []))


def bucket_of(column: str, bounds: list):
    """Number of bounds <= the value, by bisection; nulls go to bucket 0 (they sort first)."""
    if not bounds:
        return F.lit(0)
    # one literal, whatever the number of bounds
    edges = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= F.col(column), at + step).otherwise(at))


def prefix_totals(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Exclusive running total of ``amount`` over ``key``: one row for each key.

    Meant for per-file or per-bucket totals: as many rows as partitions.
    """
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(key).agg(F.sum(amount).alias("_amount"))
    return totals.select(key, F.coalesce(F.sum("_amount").over(w), F.lit(0)).alias(out))
