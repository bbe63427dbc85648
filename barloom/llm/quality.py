"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

Features are indicators of hashed byte n-grams (1 to 4 bytes of the whole text)
and of one bin for length and variety (distinct 4-grams per byte), so that a
text of repeated words differs from plain prose. An indicator's value is its
class log-count ratio; a text's vector is scaled to unit length. A linear
hinge-loss model is fitted by dual coordinate descent, and a logistic curve on
held-back rows of the sample turns its margin into a score.

The fit uses labelled rows in order of their id's hash, at most ``max_rows`` of
them and ``max_bytes`` of their features: the documented bound, which holds in
the task that fits whatever texts are like. Scoring covers every row and whole texts.

Null and empty texts have only their length bin and get a score like any other.
Rows with a null id, null label or null remainder are never learned from. With
labels of one class or none the score is that class's share (0.5 with none).
Labels repeated for an id count as often as they stand; labels that disagree
pull in both directions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import row_slices, written

#: Places of 1-grams, 2-grams, 3-grams and 4-grams, then 16 x 16 bins.
SIZES = (256, 1 << 16, 1 << 17, 1 << 17)
BASES = np.cumsum((0, *SIZES))
FEATURES = int(BASES[-1]) + 256


def indicators(text: str | None, marks: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of a text. ``marks`` is an all-False work array."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    n = len(data)
    marks[data] = True
    variety = 0.0
    if n > 1:
        two = data[:-1] << 8 | data[1:]
        marks[BASES[1] + two] = True
    if n > 2:
        three = two[:-1] << 8 | data[2:]
        marks[BASES[2] + (three * np.uint32(0x9E3779B1) >> np.uint32(15))] = True
    if n > 3:
        four = (two[:-2] * np.uint32(0x85EBCA6B) ^ (two[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))) * np.uint32(0x9E3779B1)
        marks[BASES[3] + (four >> np.uint32(15))] = True
    found = np.flatnonzero(marks)
    marks[found] = False
    if n > 3:
        variety = (len(found) - np.searchsorted(found, BASES[3])) / min(n - 3, SIZES[3])
    spread = 0 if variety <= 0 else int(np.clip(15 + np.log2(variety) * 2, 0, 15))
    return np.append(found, BASES[-1] + 16 * min(15, int(n).bit_length()) + spread)


@dataclass
class QualityModel:
    ratio: np.ndarray  # class log-count ratio of each feature
    weight: np.ndarray  # hinge-loss weights, already times the ratio
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratio[found]).sum())) or 1.0
        return float(self.weight[found].sum()) / length + self.bias

    def score(self, found: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    up, down = np.full(FEATURES, smooth), np.full(FEATURES, smooth)
    for found, y in zip(rows, labels, strict=True):
        (up if y > 0 else down)[found] += 1
    return np.log(up / up.sum()) - np.log(down / down.sum())


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: np.ndarray, sweeps: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2/2 + sum cost * hinge, by its dual.

    The weights come times the ratio, so that no row's values are stored: a
    row's margin is a sum of weights at its features, over the row's length.
    """
    square = np.square(ratio)
    scale = [1.0 / (np.sqrt(square[found].sum()) or 1.0) for found in rows]
    weight, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(sweeps):
        largest = 0.0
        for i in order.permutation(len(rows)):
            gradient = labels[i] * (weight[rows[i]].sum() * scale[i] + bias) - 1.0
            changed = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # |x|^2 is 1, and 1 for the bias
            step = (changed - alpha[i]) * labels[i]
            if step:
                weight[rows[i]] += step * scale[i] * square[rows[i]]
                bias += step
                alpha[i] = changed
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weight, bias


def fit(rows: list[np.ndarray], labels: list[int], cost: float = 1.0, sweeps: int = 30, seed: int = 7) -> QualityModel:
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if len(y) < 2 or (y > 0).all() or (y < 0).all():
        return QualityModel(np.zeros(0), np.zeros(0), 0.0, 1.0, 0.0, float(np.mean(y > 0)) if len(y) else 0.5)

    def train(at: np.ndarray):
        some, own = [rows[i] for i in at], y[at]
        ratio = log_count_ratio(some, own)
        balance = np.where(own > 0, len(own) / max(1, 2 * (own > 0).sum()), len(own) / max(1, 2 * (own < 0).sum()))
        weight, bias = dual_coordinate_descent(some, own, ratio, cost * balance, sweeps, seed)
        return ratio, weight, bias

    held = np.arange(len(y)) % 5 == 0
    slope, offset = 3.0, 0.0
    if 0 < (y[held] > 0).sum() < held.sum() and 0 < (y[~held] > 0).sum() < (~held).sum():
        trial = QualityModel(*train(np.flatnonzero(~held)), 1.0, 0.0)
        slope, offset = _logistic(np.array([trial.margin(rows[i]) for i in np.flatnonzero(held)]), y[held] > 0)
    return QualityModel(*train(np.arange(len(y))), slope, offset)


def _logistic(x: np.ndarray, up: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(up) by Newton steps, with smoothed targets and a positive slope."""
    target = np.where(up, (up.sum() + 1) / (up.sum() + 2), 1 / ((~up).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, target - p
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() - 1e-3 * a, g.sum() - 1e-3 * b])
        a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 0.1), b


def train_quality(documents: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = 6000, max_bytes: int = 160_000_000) -> QualityModel:
    """Fit on labelled rows in order of their id's hash, within the bounds.

    ``learn`` is a predicate on doc_id that says which labels may be used.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if learn is not None:
        usable = usable.where(learn)
    chosen = usable.select("doc_id", (F.col("quality") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # max_rows ids at most
    texts = documents.select("doc_id", "text").join(F.broadcast(written(chosen, "labels")), "doc_id")

    def run(batches):
        marks = np.zeros(FEATURES, bool)
        for part in row_slices(batches, "text"):
            found = [indicators(t, marks).astype("<i4").tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])

    found = texts.mapInArrow(run, "doc_id long, label int, found binary").withColumn("row", F.monotonically_increasing_id())
    found = written(found, "features")  # fixes the row numbers
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("mark")]
    first = found.select("row", "doc_id", "label", F.xxhash64("found").alias("mark"), F.length("found").alias("size")).orderBy(*order).limit(max_rows)
    # a running total over max_rows numbers at most
    first = first.withColumn("total", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= max_bytes)
    got = found.join(F.broadcast(first.select("row", "total")), "row").select("total", "row", "label", "found")

    def train(batches):
        kept = list(batches)
        # views of the Arrow buffers: the task holds the sample's features once
        made = fit([np.frombuffer(x.as_buffer(), "<i4") for b in kept for x in b.column("found")], [y for b in kept for y in b.column("label").to_pylist()])
        yield pa.RecordBatch.from_pylist([{"ratio": made.ratio.tobytes(), "weight": made.weight.tobytes(), "numbers": [made.bias, made.slope, made.offset], "constant": made.constant}], schema=kinds)

    # the sample is one task's: the driver gets the model alone
    kinds = pa.schema([("ratio", pa.binary()), ("weight", pa.binary()), ("numbers", pa.list_(pa.float64())), ("constant", pa.float64())])
    made = got.repartition(1).sortWithinPartitions("total", "row").mapInArrow(train, "ratio binary, weight binary, numbers array<double>, constant double").first()
    if made is None:
        return fit([], [])
    return QualityModel(np.frombuffer(made["ratio"]), np.frombuffer(made["weight"]), *[float(v) for v in made["numbers"]], made["constant"])


def score_quality(documents: DataFrame, model: QualityModel, out: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of its whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, whatever the corpus
    names = [f.name for f in documents.schema.fields if f.name != out]
    kept = documents.select(*[F.col(f"`{n}`") for n in names])

    def run(batches):
        model, marks = shared.value, np.zeros(FEATURES, bool)
        for part in row_slices(batches, "text"):
            scores = [model.score(indicators(t, marks)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)
