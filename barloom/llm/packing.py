"""Best-fit packing of token pieces with exact-complement hashing.

Only the histogram of piece lengths (at most ``capacity`` bins) decides how
sequences are composed, so the plan is made from counts, whatever the number
of documents: for a length the exact complement is looked up among single,
pair and triple sums of lengths still available and consumed as often as the
counts allow; what no exact combination fills is packed best-fit, again on
counts. Pieces then take their places by rank among pieces of their length.
Ranks come from per-task ranks plus running totals, never from one task.

Null texts are empty (one end id). Documents of equal length or equal text are
interchangeable and keep their own rows. Nothing is dropped: only documents
longer than a sequence are cut.
"""

from __future__ import annotations

import bisect
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import word_bpe
from barloom.llm.common import row_slices, written

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, rank_in_task long"


def token_pieces(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row for each piece of each document, numbered by length within its task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe = word_bpe.coder(tokenizer_path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in row_slices(batches, "text"):
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), bpe.encode_batch(part.column("text").to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    data = ids[at : at + 4 * capacity]
                    length = len(data) // 4
                    rows.append((doc_id, piece, at // 4, length, word_bpe.crc32_of(data), task, int(seen[length])))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using every piece once."""
    left = dict(sorted(histogram.items()))
    made: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> int:
        """Make as many sequences of these lengths as the counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(left.get(x, 0) // k for x, k in need.items())
        if times:
            made.append((lengths, times))
            for x, k in need.items():
                left[x] -= k * times
                if not left[x]:
                    del left[x]
        return times

    use((capacity,))
    # pair sums of lengths: sum -> the smaller length of each pair, as numbers, not objects (there may be
    # capacity^2 / 4 pairs); triples are looked up as one length and a pair
    order = sorted(left)
    for gap_parts in (1, 2, 3):
        pairs: dict[int, array] = {}
        if gap_parts > 1:
            present = sorted(left)
            for i, a in enumerate(present):
                for b in present[i:]:
                    if a + b >= capacity:
                        break
                    if a != b or left[a] > 1:
                        if a + b not in pairs:
                            pairs[a + b] = array("I")
                        pairs[a + b].append(a)
        for big in reversed(order):
            while left.get(big):
                gap, done = capacity - big, 0
                if gap_parts == 1:
                    if left.get(gap, 0):
                        done = use((big, gap))
                elif gap_parts == 2:
                    options = pairs.get(gap, ())
                    while options and not done:
                        done = use((big, options[-1], gap - options[-1]))
                        if not done:
                            options.pop()
                else:
                    for c in reversed(present[: bisect.bisect_right(present, gap)]):
                        if c not in left:
                            continue
                        options = pairs.get(gap - c, ())
                        while options and not done:
                            a, b = options[-1], gap - c - options[-1]
                            if a in left and b in left:
                                done = use((big, c, a, b))
                                if not done:
                                    break
                            else:
                                options.pop()
                        if done:
                            break
                if not done:
                    break
    # residuals, best fit: the longest piece first, then always the longest that fits
    present = sorted(left)
    while present:
        big = present[-1]
        lengths, gap = [big], capacity - big
        need = {big: 1}
        at = len(present) - 1
        while gap > 0:
            at = min(at, bisect.bisect_right(present, gap) - 1)
            if at < 0:
                break
            x = present[at]
            if left[x] > need.get(x, 0):
                lengths.append(x)
                need[x] = need.get(x, 0) + 1
                gap -= x
            else:
                at -= 1
        use(tuple(lengths))
        present = [x for x in present if x in left]
    return made


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, one past the last rank, first sequence, offset)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in made:
        offset = 0
        for x in lengths:
            at = taken.get(x, 0)
            rows.append((x, at, at + times, sequence, offset))
            taken[x] = at + times
            offset += x
        sequence += times
    return rows


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = documents.sparkSession
    pieces = written(token_pieces(documents, tokenizer_path, end_id, capacity), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("rank_base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").count().withColumnRenamed("count", "n").collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(_by_length(slots(plan(histogram, capacity))))

    def run(batches):
        table = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, seq, off = table[int(x)]
                at = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows] = seq[at] + rank[rows] - first[at]
                offset[rows] = off[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [batch.column(c) if c != "length" else batch.column(c).cast(pa.int64()) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    # a hot length has one row in by_task for each task: both sides are dealt by (task, length)
    ranked = pieces.join(by_task.hint("shuffle_hash"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank_in_task") + F.col("rank_base")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_length(rows) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in rows:
        out.setdefault(length, []).append((first, sequence, offset))
    return {x: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for x, v in out.items()}
