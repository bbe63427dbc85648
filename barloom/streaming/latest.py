"""A sink that keeps the latest row of each key, for any number of batches and restarts.

Every batch writes its own latest rows to a folder of its own, named by the run
and the batch id, so that a batch that comes again writes the same folder. Now
and then the folders are merged into one base, and what it has taken in is
removed after it is complete. Merging takes the latest row of each key, which
does not mind rows that are there twice: whatever is left behind by a failure,
or written again by a batch that was merged before, changes nothing. No batch
needs the one before, only what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.windows import TS


def newest(rows: DataFrame, keys: tuple[str, ...], order: str = TS) -> DataFrame:
    """One row a key, the last by ``order``; of equal ones the larger by a hash of
    all columns, so that every merge takes the same one. A null order counts as first."""
    columns = rows.columns
    place = F.struct(F.coalesce(F.unix_micros(F.col(order).cast("timestamp")), F.lit(-(2**63))), F.xxhash64(*columns))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in columns if c not in keys]), place).alias("_r")).select(*keys, "_r.*").select(*columns)


class LatestSink:
    """Use as ``writeStream.foreachBatch(LatestSink(folder, keys, run))``.

    ``folder`` is shared by all executors; ``run`` names the query's checkpoint: a
    query that starts with a new checkpoint counts its batches anew and needs a
    name of its own. Every ``merge_every`` batches are merged into the base.
    """

    def __init__(self, folder: str, keys: tuple[str, ...] = ("series_id",), run: str = "run", merge_every: int = 16, order: str = TS):
        self.folder, self.keys, self.run, self.merge_every, self.order = folder.rstrip("/"), tuple(keys), run, merge_every, order

    def __call__(self, batch: DataFrame, number: int) -> None:
        newest(batch, self.keys, self.order).write.mode("overwrite").parquet(f"{self.folder}/batch-{self.run}-{number}")
        if (number + 1) % self.merge_every == 0:
            self.merge(batch.sparkSession)

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The latest row of each key, of all batches that are complete; None before the first."""
        return self._merged(spark, self._parts(spark))

    def merge(self, spark: SparkSession) -> None:
        """One base instead of all that is there now."""
        parts = self._parts(spark)
        merged = self._merged(spark, parts)
        if merged is None or len(parts) < 2:
            return
        bases = [int(p.rsplit("-", 1)[1]) for p in parts if p.startswith("base-")]
        base = f"base-{max(bases, default=-1) + 1}"
        merged.write.mode("overwrite").parquet(f"{self.folder}/{base}")
        files, at = self._files(spark)
        for part in parts:
            files.delete(at(f"{self.folder}/{part}"), True)

    def _files(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _parts(self, spark: SparkSession) -> list[str]:
        """Names of the folders that a finished write has left."""
        files, at = self._files(spark)
        if not files.exists(at(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at(self.folder))]
        return sorted(n for n in names if n.startswith(("base-", "batch-")) and files.exists(at(f"{self.folder}/{n}/_SUCCESS")))

    def _merged(self, spark: SparkSession, parts: list[str]) -> DataFrame | None:
        if not parts:
            return None
        return newest(spark.read.parquet(*[f"{self.folder}/{p}" for p in parts]), self.keys, self.order)
