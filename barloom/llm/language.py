"""Language ID by interpolated Kneser-Ney character models.

One character model per language, orders 1 to 4 with absolute discounting and
continuation counts below the top order. All n-grams seen stand in one sorted
array of hashes for each order, with a column of log-probabilities and of
backoff weights for each language: a look-up is one binary search for all
languages. The language of lowest cross-entropy per character wins; a text is
rejected when even that exceeds what texts of the language reach that the
models were not fitted on, with a margin that widens for short texts.

Text is lower-cased; whatever is not a letter counts as one blank. A null text
or one without a letter is ``und`` with score 0. Learned languages come from
the non-null values of ``lang``; a language without rows is not learned. With
no language at all every text is ``und``. Ties go to the language that sorts
first. The fit uses about ``max_docs`` texts for each language, a fifth of them
to calibrate the rejection, chosen by id hash among those of at most
``max_chars`` characters: the documented bound. Every text is scored whole, in
steps of bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import row_slices, written

ORDER = 4
#: Symbols of one step, and characters beyond which a text is cut into symbols piece by piece.
STEP, PIECE = 1 << 18, 1 << 20
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, non-letters as single blanks (0).

    Each text with a letter begins and ends with a blank; the second array has
    its first place (and one more entry, the end).
    """
    coded = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(c) for c in coded])
    points = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
    points = np.where(_letter_table()[points], points, 0)
    first = np.zeros(len(points), bool)
    first[np.cumsum(sizes) - sizes] = True
    keep = (points > 0) | first
    keep[1:] |= points[:-1] > 0
    starts = np.cumsum(np.append(0, keep))[np.append(np.cumsum(sizes) - sizes, len(points))]
    return points[keep].astype(np.uint64), starts


def gram_hashes(points: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each order n the hash of the n symbols that end at a place; 0 where
    the text (``place`` counts from its first blank) has fewer before it."""
    n = len(points)
    keys, key = [], np.zeros(n, np.uint64)
    for order in range(1, ORDER + 1):
        older = np.zeros(n, np.uint64)
        older[order - 1 :] = points[: max(0, n - order + 1)]
        key = (key * np.uint64(3) + older + np.uint64(order)) * _MIX
        key = key ^ (key >> np.uint64(29))
        keys.append(np.where(place >= order - 1, key | np.uint64(1), np.uint64(0)))
    return keys


def places_of(starts: np.ndarray) -> np.ndarray:
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


@dataclass
class LanguageModel:
    languages: list[str]
    grams: list[np.ndarray]  # sorted hashes by order
    logp: list[np.ndarray]  # (grams, languages)
    backoff: list[np.ndarray]  # log weight passed below a context, (grams, languages)
    floor: np.ndarray  # log-probability of a symbol never seen
    mean: np.ndarray
    spread: np.ndarray

    def place_scores(self, keys: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each place under each language."""
        n = len(keys[0])
        out = np.empty((n, len(self.languages)), np.float32)
        todo, passed = np.arange(n), None
        for order in range(ORDER, 0, -1):
            grams, own = self.grams[order - 1], keys[order - 1][todo]
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            hit = grams[at] == own
            got = self.logp[order - 1][at[hit]]
            out[todo[hit]] = got if passed is None else got + passed[hit]
            todo, miss = todo[~hit], ~hit
            passed = None if passed is None else passed[miss]
            if order > 1 and len(todo):  # the context is what stands before: its hash ends one place earlier
                contexts = self.grams[order - 2]
                before = np.where(keys[order - 1][todo] > 0, keys[order - 2][todo - 1], np.uint64(0))
                at = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
                weight = np.where((contexts[at] == before)[:, None], self.backoff[order - 2][at], np.float32(0))
                passed = weight if passed is None else passed + weight
        if len(todo):
            out[todo] = self.floor if passed is None else self.floor + passed
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per symbol by text and language, symbols by text)."""
        total, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t or "") <= PIECE]
        if short:
            points, starts = symbols([texts[i] for i in short])
            place, of = places_of(starts), np.repeat(short, np.diff(starts))
            for at in range(0, len(points), STEP):
                low, high = max(0, at - ORDER), min(len(points), at + STEP)
                self._add(total, points[low:high], place[low:high], at - low, of[at:high])
            sizes[short] = np.diff(starts) - 1  # predicted symbols; 0 for a text without a letter
        for i, t in enumerate(texts):
            if len(t or "") > PIECE:
                sizes[i] = self._long(total, i, t.lower()) - 1
        return -total / np.maximum(sizes, 1)[:, None], np.maximum(sizes, 0)

    def _add(self, total: np.ndarray, points: np.ndarray, place: np.ndarray, known: int, of: np.ndarray) -> None:
        """Add the scores of the places after the first ``known`` to their texts' totals."""
        scores = self.place_scores(gram_hashes(points, place))[known:].astype(np.float64)
        scores[place[known:] == 0] = 0  # a text's first blank is given
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        total[of[first]] += np.add.reduceat(scores, first, axis=0)

    def _long(self, total: np.ndarray, i: int, text: str) -> int:
        """Add a long text's scores piece by piece; its number of symbols."""
        tail, done = np.zeros(1, np.uint64), 0  # the text's first blank
        for at in range(0, len(text) + 1, PIECE):
            piece = text[at : at + PIECE] + (" " if at + PIECE > len(text) else "")
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
            points = np.where(_letter_table()[points], points, 0).astype(np.uint64)
            points = points[(points > 0) | np.append(tail[-1] > 0, points[:-1] > 0)]
            if not done:
                points, tail = np.append(tail, points), tail[:0]
            for k in range(0, len(points), STEP):
                own = points[k : k + STEP]
                both = np.append(tail, own)
                self._add(total, both, done - len(tail) + np.arange(len(both)), len(tail), np.full(len(own), i))
                tail, done = both[-ORDER:], done + len(own)
        return done

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        entropy, sizes = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        odds = np.exp(-np.minimum(sizes, 50)[:, None] * (entropy - lowest[:, None])).sum(axis=1)
        limit = self.mean[best] + self.spread[best] * (1 + 8 / np.sqrt(np.maximum(sizes, 1)))
        none = sizes == 0
        names = [UNDETERMINED if z else self.languages[b] for z, b in zip(none, best, strict=True)]
        return names, np.where(none, 0.0, 1 / odds).tolist(), (none | (lowest > limit)).tolist()


def fit(counts: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]) -> LanguageModel:
    """Build the arrays. ``counts``: for each language and order (hashes, counts,
    suffix hashes, context hashes). The rejection is wide until it is calibrated."""
    languages = sorted(counts)
    size = len(languages)
    grams = [np.unique(np.concatenate([counts[x][o][0] for x in languages])) if size else np.zeros(0, np.uint64) for o in range(ORDER)]
    if not size:
        return LanguageModel([], grams, [], [], np.zeros(0), np.zeros(0), np.zeros(0))
    logp = [np.zeros((len(g), size), np.float32) for g in grams]
    backoff = [np.zeros((len(g), size), np.float32) for g in grams]
    floor = np.zeros(size, np.float32)
    suffix = [np.zeros(len(g), np.int64) for g in grams]
    context = [np.zeros(len(g), np.int64) for g in grams]
    for x in languages:
        for o in range(1, ORDER):
            keys, _, below, before = counts[x][o]
            at = np.searchsorted(grams[o], keys)
            suffix[o][at] = np.searchsorted(grams[o - 1], below)
            context[o][at] = np.searchsorted(grams[o - 1], before)
    for i, x in enumerate(languages):
        used = []
        for o in range(ORDER):
            c = np.zeros(len(grams[o]))
            if o == ORDER - 1:
                c[np.searchsorted(grams[o], counts[x][o][0])] = counts[x][o][1]
            else:  # continuation: in how many different n-grams above it is the end
                at = np.searchsorted(grams[o + 1], counts[x][o + 1][0])
                np.add.at(c, suffix[o + 1][at], 1)
            used.append(c)
        once, twice = (used[ORDER - 1] == 1).sum(), (used[ORDER - 1] == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.75
        total = used[0].sum() or 1.0
        kinds = (used[0] > 0).sum()
        unseen = discount * kinds / total / 5000  # what discounting frees, spread over an alphabet's worth of symbols
        p = np.maximum(used[0] - discount, 0) / total + unseen
        logp[0][:, i] = np.log(np.maximum(p, 1e-12))
        floor[i] = np.log(max(unseen, 1e-12))
        for o in range(1, ORDER):
            c = used[o]
            sums = np.bincount(context[o], c, len(grams[o - 1]))
            follow = np.bincount(context[o], c > 0, len(grams[o - 1]))
            freed = np.where(sums > 0, discount * follow / np.maximum(sums, 1e-12), 1.0)
            backoff[o - 1][:, i] = np.log(freed)
            lower = np.exp(logp[o - 1][suffix[o], i].astype(np.float64))
            p = np.maximum(c - discount, 0) / np.maximum(sums[context[o]], 1e-12) * (sums[context[o]] > 0) + freed[context[o]] * lower
            logp[o][:, i] = np.log(np.maximum(p, 1e-12))
    return LanguageModel(languages, grams, logp, backoff, floor, np.full(size, 3.0), np.full(size, 2.0))


def train_languages(documents: DataFrame, learn: Column | None = None, max_docs: int = 500, max_chars: int = 100_000) -> LanguageModel:
    """Fit on about ``max_docs`` whole texts of each language, chosen by id hash;
    every fifth of them calibrates the rejection instead."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        usable = usable.where(learn)
    usable = usable.where(F.length("text") <= max_chars).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return fit({})
    rate = F.element_at(F.create_map(*[F.lit(v) for x, n in sorted(sizes.items()) for v in (x, min(1.0, max_docs / n))]), F.col("lang"))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < rate * (1 << 20))
    held = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0
    sample = written(sample.withColumn("held", held), "languages")

    def run(batches):
        for part in row_slices(batches, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            points, starts = symbols(part.column("text").to_pylist())
            keys = gram_hashes(points, places_of(starts))
            of = np.repeat(np.arange(len(langs)), np.diff(starts))
            for x in sorted(set(langs)):
                mine = (langs == x)[of]
                mine[starts[:-1]] = False
                for o in range(ORDER):
                    at = np.flatnonzero(mine & (keys[o] > 0))
                    key, where, count = np.unique(keys[o][at], return_index=True, return_counts=True)
                    where = at[where]
                    below = keys[o - 1][where] if o else np.zeros(len(key), np.uint64)
                    before = keys[o - 1][where - 1] if o else np.zeros(len(key), np.uint64)
                    columns = [pa.array([x] * len(key), pa.string()), pa.array([o] * len(key), pa.int32()), *[pa.array(v.view(np.int64)) for v in (key, below, before)], pa.array(count.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "o", "key", "below", "before", "n"])

    grams = sample.where("not held").select("lang", "text").mapInArrow(run, "lang string, o int, key long, below long, before long, n long")
    # bounded by the sample: about max_docs texts of each language
    got = grams.groupBy("lang", "o", "key").agg(F.min("below").alias("below"), F.min("before").alias("before"), F.sum("n").alias("n")).toArrow().to_pandas()
    counts: dict[str, list] = {}
    for x, rows in got.groupby("lang"):
        counts[x] = []
        for o in range(ORDER):
            own = rows[rows.o == o]
            key = own.key.to_numpy(np.int64).view(np.uint64)
            order = np.argsort(key)
            counts[x].append((key[order], own.n.to_numpy()[order], own.below.to_numpy(np.int64).view(np.uint64)[order], own.before.to_numpy(np.int64).view(np.uint64)[order]))
    return calibrated(fit(counts), sample.where("held").select("lang", "text"))


def calibrated(model: LanguageModel, texts: DataFrame) -> LanguageModel:
    """``model`` with the rejection set by texts it was not fitted on: 1.25 times
    the largest excess over their mean cross-entropy, at least half a nat."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for part in row_slices(batches, "text", 500_000):
            entropy, sizes = model.entropies(part.column("text").to_pylist())
            own = [model.languages.index(x) if x in model.languages else -1 for x in part.column("lang").to_pylist()]
            keep = np.flatnonzero((sizes >= 20) & (np.array(own) >= 0))
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in keep], pa.int32()), pa.array([entropy[i, own[i]] for i in keep], pa.float64())], names=["own", "entropy"])

    for r in texts.mapInArrow(run, "own int, entropy double").groupBy("own").agg(F.avg("entropy").alias("mean"), F.max("entropy").alias("most")).collect():  # a row for each language
        model.mean[r["own"]], model.spread[r["own"]] = r["mean"], max(0.5, 1.25 * (r["most"] - r["mean"]))
    return model


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``documents``, then lang_pred, score, rejected."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    added = ("lang_pred", "score", "rejected")
    kept = documents.select(*[F.col(f"`{n}`") for n in documents.columns if n not in added])
    names = kept.columns
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("rejected", F.lit(False)).schema

    def run(batches):
        model = shared.value
        for part in row_slices(batches, "text", 500_000):
            found, scores, rejected = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, *added])

    return kept.mapInArrow(run, schema)
