"""Near-duplicate documents: a multi-index Hamming join of minwise signatures.

1. Each text becomes its set of word shingles and a signature of ``chunks`` x
   ``width`` b-bit minwise values. Texts with equal sets become one node.
2. Signatures are split into chunks. If two differ in at most
   ``chunks * (errors + 1) - 1`` values, some chunk differs in at most
   ``errors`` (pigeonhole). With one error allowed a chunk's keys are its values
   with each one left out in turn, so any such pair shares a key. Keys that
   hold the same nodes are one group.
3. Groups are cut into cells of at most two blocks. A cell compares all its
   signatures and names its close pairs by a forest: as many links as join
   what is close, closest first, fewer than it has nodes. Of groups larger than
   a block the links to the smallest node are confirmed first, so that a large
   family of copies is known to be one and not compared with itself again.
4. Links are confirmed on full sets, pair by pair. Where close nodes are still
   not all of one class, they meet once more with their full sets, and every
   close pair of different classes is confirmed, closest first.
5. Components of the confirmed links give each document its class.

The guarantee covers signature distances up to the threshold (17 of 54); a pair
at a similarity of exactly 0.8 shares no key with probability 7e-5 by default.
Pairs further apart than ``CLOSE`` values are not confirmed: at 0.8 that has
probability below 1e-9.

Null and empty texts have no shingles and link with nothing; a null doc_id
links with nothing and has a null component. Equal rows are in one class. A
doc_id that stands on different texts has each row's class.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import discard, row_slices, shuffle_partitions, written
from barloom.llm.components import components
from barloom.llm.shingles import drawn, mixed, shingle_sets, signature

CHUNKS, WIDTH = 9, 6
#: Signature distance (of 54 values) up to which pairs are confirmed.
CLOSE = 30
#: Nodes of a block; a cell holds two blocks at most.
BLOCK = 1000


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each chunk with one value left out: chunks * width numbers."""
    values = sig.reshape(CHUNKS, WIDTH).astype(np.uint64)
    factors = drawn(CHUNKS * WIDTH, 5).reshape(CHUNKS, WIDTH) | np.uint64(1)
    with np.errstate(over="ignore"):
        terms = mixed((values + np.uint64(1)) * factors)
        left = terms.sum(axis=1, keepdims=True) - terms
        return mixed(left + drawn(CHUNKS * WIDTH, 6).reshape(CHUNKS, WIDTH)).ravel().view(np.int64)


def with_hash(documents: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: a doc_id may stand on several texts."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def sketches(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, sig of each row (null key and sig: no shingles)."""

    def run(batches):
        for part in row_slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            keys = [_set_key(s) if len(s) else None for s in sets]
            sigs = [signature(s, CHUNKS * WIDTH).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_key", "sig"])

    return with_hash(documents).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary")


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [chunk_keys(np.frombuffer(s, np.uint16)) for s in batch.column("sig").to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(batch.column("node").to_numpy(), CHUNKS * WIDTH))], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def close_pairs(sigs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Close pairs of different labels, closest first: (left, right)."""
    left, right, far = [], [], []
    for i in range(len(sigs) - 1):
        at = np.flatnonzero((labels[i + 1 :] != labels[i]) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])))
        if len(at):
            apart = (sigs[at + i + 1] != sigs[i]).sum(axis=1, dtype=np.uint8)
            at, apart = at[apart <= CLOSE], apart[apart <= CLOSE]
            left.append(np.full(len(at), i, np.int32))
            right.append((at + i + 1).astype(np.int32))
            far.append(apart)
    if not left:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    order = np.argsort(np.concatenate(far), kind="stable")
    return np.concatenate(left)[order], np.concatenate(right)[order]


def forest(sigs: np.ndarray, sizes: np.ndarray, labels: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join what is close, closest first; with ``sets`` only links that they confirm."""
    of = {x: i for i, x in enumerate(dict.fromkeys(labels.tolist()))}
    start = [of[x] for x in labels.tolist()]
    root = list(range(len(of)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    left, right = close_pairs(sigs, sizes, labels, percent)
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = top(start[i]), top(start[j])
        if a == b or sets is not None and not similar(sets[i], sets[j], percent):
            continue
        root[max(a, b)] = min(a, b)
        links.append((i, j))
    return links


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _near(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures are close."""
    both = pairs.join(sketch.toDF("a", "sig_a", "size_a").hint("shuffle_hash"), "a").join(sketch.toDF("b", "sig_b", "size_b").hint("shuffle_hash"), "b")
    both = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    places = F.sequence(F.lit(0), F.lit(CHUNKS * WIDTH - 1))
    apart = F.filter(places, lambda i: F.substring(F.col("sig_a"), i * 2 + 1, F.lit(2)) != F.substring(F.col("sig_b"), i * 2 + 1, F.lit(2)))
    return both.where(F.size(apart) <= CLOSE).select("a", "b")


def _cells(members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (keys, node, label, ...) dealt to cells of two blocks.

    A group's most frequent label is not compared with itself: its blocks meet
    the blocks of all other nodes, and those meet each other.
    """
    by_label = members.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    shape = by_label.groupBy(*keys).agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    shape = shape.select(*keys, F.col("main.label").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("main_blocks"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("blocks"))
    df = members.join(shape.hint("shuffle_hash"), keys).withColumn("is_main", F.col("label") == F.col("main"))
    block = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int")
    # the main label's blocks come after the others
    df = df.withColumn("block", F.when(F.col("is_main"), block + F.col("blocks")).otherwise(block))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    df = df.withColumn("other", F.explode(F.when(F.col("is_main"), others).otherwise(F.sequence(F.lit(0), F.col("blocks") + F.col("main_blocks") - 1))))
    df = df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return df.drop("main", "main_blocks", "blocks", "is_main", "other", "block")


def _forest_of(members: DataFrame, keys: list[str], percent: int, confirm: bool) -> DataFrame:
    """Links (a, b) found in the cells of ``members`` (keys, node, label, sig, size and, to confirm, shingles)."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.drop_duplicates("node").sort_values("node")
        sigs = np.frombuffer(b"".join(cell["sig"]), np.uint16).reshape(len(cell), -1)
        sets = [np.frombuffer(s, np.uint64) for s in cell["shingles"]] if confirm else None
        found = np.array(forest(sigs, cell["size"].to_numpy(), cell["label"].to_numpy(), percent, sets), np.int64).reshape(-1, 2)
        ids = cell["node"].to_numpy()
        return pd.DataFrame({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return _cells(members, keys).groupBy(*keys, "low", "high").applyInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")).hint("shuffle_hash")

    def run(batches):
        for batch in batches:
            both = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _full_sets(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes, from one text of each read once more."""
    found = nodes.join(wanted.hint("shuffle_hash"), "node", "left_semi").select(F.col("rep").alias("doc_id"), "text_hash", "node", "set_key")
    texts = with_hash(documents).join(found.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("node", "set_key", "text")

    def run(batches):
        for part in row_slices(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            same = pa.array([_set_key(s) == k for s, k in zip(sets, part.column("set_key").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]).filter(same)

    # the same row may stand several times
    return texts.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _labelled(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` with the class of each node (its own number where it has no link)."""
    known = classes.select("node", F.col("component").alias("label"))
    return members.join(known.hint("shuffle_hash"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _links(documents: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of nodes: as many as join what is linked, and a few more."""
    keys = _keys(nodes)
    groups = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("first < last")
    # keys with the same nodes are one group
    groups = written(groups.groupBy("first", "last", "n", "mark").agg(F.min("key").alias("key")).select("key", "first", "last", "n"), "keys")
    sketch = nodes.select("node", "sig", "size")
    # a group of two is one pair, which needs no cell
    twos = _near(groups.where("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b")).distinct(), sketch, percent)
    members = written(keys.join(groups.where("n > 2").hint("shuffle_hash"), "key").select("key", "node", "first", "n"), "groups")

    stars = members.where((F.col("n") > BLOCK) & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = _near(stars, sketch, percent)
    stars = written(near.select("a", "b"), "stars")
    links, classes = [], None
    if not stars.isEmpty():
        ends = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = written(_full_sets(documents, nodes, ends, words), "star-sets")
        links.append(written(_confirmed(stars, sets, percent), "star-links"))
        classes = components(links[0], name="star-classes")
        discard(sets)
    of_group = members.select("key", "node")
    of_group = _labelled(of_group, classes) if classes is not None else of_group.withColumn("label", F.col("node"))
    with_sketch = of_group.join(sketch.hint("shuffle_hash"), "node")
    close = written(_forest_of(with_sketch, ["key"], percent, False).unionByName(twos).distinct(), "close")
    discard(members, stars, groups)

    ends = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_full_sets(documents, nodes, ends, words), "sets")
    links.append(written(_confirmed(close, sets, percent), "close-links"))
    so_far = links[0].unionByName(links[1]) if len(links) > 1 else links[0]
    classes = components(so_far, name="classes-so-far")
    # what is close, with whole classes in between: only regions of more than one class are compared again
    regions = components(close.unionByName(links[0]) if len(links) > 1 else close, name="regions").withColumnRenamed("component", "region")
    last = _labelled(regions, classes).join(sketch.hint("shuffle_hash"), "node")
    salts = shuffle_partitions(documents.sparkSession)  # one region may hold a third of all nodes
    mixed_regions = last.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("region", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    last = last.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(mixed_regions.hint("shuffle_hash"), ["region", "salt"], "left_semi").drop("salt").join(sets.hint("shuffle_hash"), "node")
    links.append(written(_forest_of(last, ["region"], percent, True), "last-links"))
    discard(sets, close)
    return so_far.unionByName(links[-1])


def classified(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, lowest of every row of ``documents``.

    ``lowest`` is struct<doc_id, text_hash> of the class's first row, null where
    a row links with nothing because its id is null or its text has no words.
    """
    rows = written(sketches(documents, words), "sketches")
    real = rows.where("set_key is not null and doc_id is not null")
    nodes = real.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "sig", "size")
    nodes = written(nodes, "nodes")  # fixes the numbers
    links = _links(documents, nodes, words, percent)
    classes = components(links, name="classes")
    first = F.struct(F.col("rep").alias("doc_id"), "text_hash")
    own = nodes.select("node", "set_key", first.alias("own")).join(classes.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = own.groupBy("component").agg(F.min("own").alias("lowest"))
    of_set = own.join(lowest.hint("shuffle_hash"), "component").select("set_key", "lowest")
    # a text's copies may be a third of all rows: one row on the right for each set, so a skewed left side can be split
    linked = real.join(of_set.hint("shuffle_hash"), "set_key", "left").select("doc_id", "text_hash", "n_shingles", "lowest")
    alone = rows.where("set_key is null or doc_id is null").select("doc_id", "text_hash", "n_shingles")
    return linked.unionByName(alone, allowMissingColumns=True)


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents``.

    Links have at least ``percent`` hundredths of the shingles of both in common.
    """
    rows = classified(documents, words, percent).select("doc_id", "n_shingles", F.coalesce("lowest.doc_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Whole rows of ``documents``: exactly one of each class, the first by id.

    Rows with null ids count as one more id, before all others; of equal rows
    one stays. Rows whose text has no words link with nothing and all stay.
    """
    marked = documents.select("*", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.xxhash64("text").alias("_hash"))
    rows = classified(marked.select(F.col("_id").alias("doc_id"), "text"), words, percent)
    first = (F.col("lowest.doc_id") == F.col("doc_id")) & (F.col("lowest.text_hash") == F.col("text_hash"))
    stay = rows.where(F.col("lowest").isNull() | first).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n"), F.first("lowest").isNotNull().alias("_linked"))
    kept = marked.join(stay.hint("shuffle_hash"), ["_id", "_hash"])
    again = (F.col("_n") > 1) & F.col("_linked")
    once = kept.where(again).withColumn("_r", F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))).where("_r = 1").drop("_r")
    return kept.where(~again).unionByName(once).select(*documents.columns)
