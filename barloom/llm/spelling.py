"""Spelling variants: words one edit apart, found by variable-length grams.

1. Words are counted over all documents, before the shuffle in each task.
2. The gram dictionary holds the grams of 2 to 4 characters that stand at more
   than a threshold of places in the words; the threshold rises with the
   number of places, so that the dictionary stays below ``MAX_GRAMS``. At each
   place a word has the gram that begins with a dictionary gram's characters
   and leaves the dictionary, at most 5 long: common beginnings give long
   grams, rare ones short grams.
3. A gram depends on the characters it was read from, so a word knows how many
   of its grams one edit can affect at most. Two words one edit apart share all
   but that many; so among that many and one more of its rarest grams each of
   them has a shared one, the same in both. Only these are indexed.
4. The edit leaves a shared gram's whole left or whole right side of the word
   alone as well, so lists are kept by the gram with its left side and by the
   gram with its right side. Lists are merged by a join and their pairs
   verified by the edit distance.
5. Lists of more than ``MAX_LIST`` words are not paired but split: the edit lies in
   one half of the side that the list leaves free, so the words are listed by
   what they list already and either half, for their own length and for that of
   a word one shorter. What is still too long is looked up exactly: a pair of
   equal length is equal without one place, a longer word without one character
   is the shorter one. Every such pair is a link, and a word has no more links
   than single edits.

No pair is lost by rank, hashing or list length: ranks only need to be the same
for all words (they come from counts in ``CELLS`` cells), hashed keys can only
add pairs, which the edit distance rejects. Words of fewer characters than the
grams need (``least_length``) are left out.

Null texts have no words; a null doc_id hashes as the empty string; repeated
rows count each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, row_slices, written

SHORTEST, LONGEST = 2, 5
MAX_GRAMS, MAX_LIST, CELLS = 50_000, 256, 1 << 18
#: Entries that a task's counter holds before it passes them on.
MAX_HELD = 300_000


def tally(held: Counter, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=list(names))


def count_words(documents: DataFrame, least_length: int = 7, slip: int = 31) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, each run of a document
    without one character if its hash is divisible by ``slip``."""
    # a result may be one character shorter than its run
    runs_of = re.compile("[a-zÀ-ÿ]{%d,}" % least_length).findall

    def run(batches):
        held: Counter = Counter()
        for part in row_slices(batches, "text"):
            texts = pc.ascii_lower(pc.fill_null(part.column("text"), "")).to_pylist()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                for word, n in Counter(runs_of(text)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) >= MAX_HELD:
                    yield tally(held, ("word", "n"))
                    held.clear()
        yield tally(held, ("word", "n"))

    counts = documents.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def gram_dictionary(words: DataFrame, least_list: int = 16) -> dict[str, int]:
    """Grams of fewer than ``LONGEST`` characters that stand at more places than
    the threshold, with their counts: fewer than ``MAX_GRAMS``, as all places
    together are less than that many times the threshold."""
    sizes = range(SHORTEST, LONGEST)
    places = words.agg(*[F.sum(F.greatest(F.char_length("word") - F.lit(q - 1), F.lit(0))).alias(f"q{q}") for q in sizes]).first()
    threshold = max(least_list, -(-sum(p or 0 for p in places) // MAX_GRAMS))

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                held.update([word[p : p + q] for q in sizes for p in range(len(word) - q + 1)])
                if len(held) >= MAX_HELD:
                    yield tally(held, ("gram", "n"))
                    held.clear()
        yield tally(held, ("gram", "n"))

    counts = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.where(F.col("n") > threshold).collect()}


def grams_of(word: str, dictionary) -> tuple[list[int], list[int]]:
    """(length of the gram at each place, characters it was read from); a gram
    that the word's end stopped was read from the end as well."""
    n, sizes, read = len(word), [], []
    for p in range(n - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and p + q < n and word[p : p + q] in dictionary:
            q += 1
        ended = q < LONGEST and p + q == n and word[p:] in dictionary
        sizes.append(q)
        read.append(q + ended)
    return sizes, read


def affected(length: int, read: list[int]) -> int:
    """Most grams that a single edit can change: those read from its place."""
    step = [0] * (length + 2)
    for p, m in enumerate(read):
        step[p] += 1
        step[p + m] -= 1
    most = here = 0
    for s in step:
        here += s
        most = max(most, here)
    return most


def cell(gram: str) -> int:
    return zlib.crc32(gram.encode()) % CELLS


def gram_cells(words: DataFrame, dictionary: dict[str, int]) -> np.ndarray:
    """Words' grams counted in ``CELLS`` cells: a table of fixed size."""

    def run(batches):
        held = np.zeros(CELLS, np.int64)
        for batch in batches:
            found = [cell(word[p : p + q]) for word in batch.column("word").to_pylist() for p, q in enumerate(grams_of(word, dictionary)[0])]
            held += np.bincount(np.array(found, np.int64), minlength=CELLS)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], names=["cell", "n"])

    counts = words.select("word").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[counts["cell"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def list_cuts(word: str, dictionary, cells: np.ndarray) -> list[int]:
    """Lists that a word stands in: for each of its rarest grams, as many as one
    edit can affect and one more, the gram with its left side (a cut c > 0: the
    first c characters) and with its right side (c <= 0: all from place -c on)."""
    sizes, read = grams_of(word, dictionary)
    order = sorted((int(cells[cell(word[p : p + q])]), word[p : p + q], p) for p, q in enumerate(sizes))
    chosen = [p for _, _, p in order[: affected(len(word), read) + 1]]
    return sorted({-p for p in chosen} | {p + read[p] for p in chosen if p + read[p] <= len(word)})


def index_words(words: DataFrame, dictionary: dict[str, int], cells: np.ndarray) -> DataFrame:
    """word, n and the cuts of its lists."""

    def run(batches):
        for batch in batches:
            found = [list_cuts(word, dictionary, cells) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(found, pa.list_(pa.int32()))], names=["word", "n", "cuts"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, cuts array<int>")


def _head(size: Column) -> Column:
    return F.substring("word", F.lit(1), size)


def _tail(size: Column) -> Column:
    """The last ``size`` characters (0: none)."""
    return F.substring("word", F.char_length("word") - size + 1, size)


def half_keys() -> Column:
    """Keys that split a word's list: what it lists (``cut``) and either half of the
    rest, for words of its own length and of one character less."""
    length, cut = F.char_length("word"), F.col("cut")
    found = []
    for shorter in (0, 1):
        base = length - shorter
        free = F.when(cut > 0, base - cut).otherwise(-cut - shorter)
        near = F.floor(free / 2).cast("int")
        far, fixed = free - near, F.when(cut > 0, cut).otherwise(length + cut)
        first = F.when(cut > 0, F.struct(_head(fixed + near).alias("a"), F.lit("").alias("b"))).otherwise(F.struct(_tail(fixed + near).alias("a"), F.lit("").alias("b")))
        second = F.when(cut > 0, F.struct(_head(fixed).alias("a"), _tail(far).alias("b"))).otherwise(F.struct(_tail(fixed).alias("a"), _head(far).alias("b")))
        for kind, part in ((0, first), (1, second)):
            found.append(F.when(free >= 0, F.xxhash64(F.lit(kind), cut > 0, base, part)))
    return F.array_compact(F.array(*found))


def _pairs(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
    """Joined on ``key``, a hash: ``extra`` tells what a pair must be besides. Its
    table holds one number for a key, so a task needs little room."""
    a, b = left.alias("a"), right.alias("b").hint("shuffle_hash")
    return a.join(b, [F.col("a.key") == F.col("b.key"), extra]).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of the lists (key) of two words or more, with their size."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(sizes.hint("shuffle_hash"), "key")


def _merged(listed: DataFrame) -> DataFrame:
    """Pairs of the lists that are not too long, verified. A list is one row of at
    most ``MAX_LIST`` words."""
    lists = listed.where(F.col("size") <= MAX_LIST).groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("list"))
    pairs = lists.select(F.explode("list").alias("a"), "list").select("a", F.explode("list").alias("b"))
    near = pairs.where((F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return near.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def near_words(words: DataFrame, least_length: int = 7) -> DataFrame:
    """(a, a_n, b, b_n) for every two words exactly one edit apart, once for each list
    that both stand in.

    ``words`` has distinct words of at least ``least_length`` characters, and n.
    """
    if least_length < LONGEST + SHORTEST:
        raise ValueError(f"an edit could affect all grams of words of fewer than {LONGEST + SHORTEST} characters")
    dictionary = gram_dictionary(words)
    indexed = written(index_words(words, dictionary, gram_cells(words, dictionary)), "spelling-lists")
    rows = indexed.select("word", "n", F.explode("cuts").alias("cut"))
    listed = _sized(rows.withColumn("key", F.xxhash64(F.col("cut") > 0, F.when(F.col("cut") > 0, _head(F.col("cut"))).otherwise(_tail(F.char_length("word") + F.col("cut"))))))
    long = written(listed.where(F.col("size") > MAX_LIST).select("word", "n", "cut"), "spelling-long")
    halved = _sized(long.select("word", "n", F.explode(half_keys()).alias("key")))
    merged = _merged(listed).union(_merged(halved))

    # words of long lists: without one place, or without one character
    heavy = halved.where(F.col("size") > MAX_LIST).select("word", "n").distinct()
    length = F.char_length("word")
    places = F.explode(F.sequence(F.lit(1), length)).alias("at")
    cut = heavy.select("word", "n", places).select("word", "n", "at", F.concat(F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, length)).alias("rest"))
    same = cut.withColumn("key", F.xxhash64("at", "rest"))
    replaced = _pairs(same, same, (F.col("a.word") < F.col("b.word")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.rest") == F.col("b.rest")))
    # of equal characters in a row only the first goes: the rest is the same
    first = cut.where((F.col("at") == 1) | (F.substring("word", F.col("at"), F.lit(1)) != F.substring("word", F.col("at") - 1, F.lit(1))))
    longer = _pairs(first.withColumn("key", F.xxhash64("rest")), heavy.withColumn("key", F.xxhash64("word")), F.col("a.rest") == F.col("b.word"))
    return merged.union(replaced).union(longer)


def spelling_forms(documents: DataFrame, least_length: int = 7, least_n: int = 2, slip: int = 31, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word seen ``least_n`` times.

    A word's form is its near word of largest n (then the smallest word), if that
    is at least ``ratio`` times its own; the root is where the forms lead.
    """
    words = written(count_words(documents, least_length, slip).where(F.col("n") >= least_n), "spelling-words")
    ends = F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("other"), (-F.col(m)).alias("less")) for x, y, m in (("a", "b", "b_n"), ("b", "a", "a_n"))])
    # dealt by word once: a word has no more near words than single edits
    near = near_words(words, least_length).select(F.explode(ends).alias("e")).select("e.*").repartition("word").dropDuplicates(["word", "other"])
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "other")).alias("near"))
    joined = words.join(best.hint("shuffle_hash"), "word", "left")
    led = -F.col("near.less") >= ratio * F.col("n")
    formed = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("near.other")).alias("form"), F.when(led, -F.col("near.less")).alias("form_n")), "spelling-forms")
    roots = _roots(formed)
    return formed.join(roots.hint("shuffle_hash"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of words with a form. Each round doubles the steps taken; n
    grows by the ratio at each step, so that the rounds are few."""
    roots = written(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = written(roots.join(on.hint("shuffle_hash"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(roots)
        if stepped.where("moved").isEmpty():
            return stepped.drop("moved")
        roots = stepped
