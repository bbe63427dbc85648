"""Document fingerprints by winnowing, in DataFrame functions only.

White space is left out; every ``k`` visible characters in a row are hashed, at
each character's place. From every ``window`` hashes in a row the smallest is
chosen, the rightmost on ties, and kept with its place. So any passage of
``window + k - 1`` visible characters that two texts share, wherever it begins,
gives both a common hash. A text with fewer characters has one hash of what it
has; one with no visible character has none. Null texts are empty; equal texts
have equal fingerprints. Texts are never cut.

A fingerprint is an array of 63-bit values: 32 bits of hash over 31 bits that
count places backwards, so that the smaller of two equal hashes stands right.
31 bits hold every place of the longest text that a column can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import bucket_of, range_buckets, shuffle_partitions

PLACE_BITS = 31
LAST_PLACE = (1 << PLACE_BITS) - 1
BLANKS = " \t\n\x0b\f\r"


def add_fingerprint(df: DataFrame, text: str, out: str, k: int = 12, window: int = 8) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` (not null) as array<bigint>."""
    coded, low, steps = f"_{out}_coded", f"_{out}_low", 1
    packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 64 - 32), PLACE_BITS) + (F.lit(LAST_PLACE).cast("long") - i)
    # four bytes a character: a gram is cut out at once, whatever its place
    df = df.withColumn(coded, F.encode(F.translate(F.col(text), BLANKS, ""), "UTF-32"))
    c = F.col(coded)
    places = F.sequence(F.lit(0), F.greatest(F.length(c) / 4 - k, F.lit(0)).cast("int"))
    # held as an array's one element: a binary column is copied at every step of a lambda function
    grams = F.transform(F.array(c), lambda b: F.transform(places, lambda i: packed(F.xxhash64(F.substring(b, i * 4 + 1, F.lit(4 * k))), i)))
    df = df.withColumn(low, F.when(F.length(c) == 0, F.array().cast("array<bigint>")).otherwise(F.get(grams, F.lit(0))))
    while steps < window:  # minima of ``steps`` hashes in a row, doubled; past the end of fewer
        more = min(steps, window - steps)
        df = df.withColumn(low, F.zip_with(low, F.slice(low, more + 1, F.greatest(F.size(low) - more, F.lit(0))), lambda a, b: F.least(a, b)))
        steps += more
    whole = F.slice(low, 1, F.greatest(F.size(low) - (window - 1), F.lit(1)))
    return df.withColumn(out, F.array_distinct(whole)).drop(coded, low)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, PLACE_BITS)))


def marks(fingerprint: Column) -> Column:
    """A fingerprint as array<struct<place, hash>>."""
    return F.transform(fingerprint, lambda v: F.struct((F.lit(LAST_PLACE) - v.bitwiseAND(F.lit(LAST_PLACE))).cast("int").alias("place"), F.shiftright(v, PLACE_BITS).alias("hash")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two hash sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def digest(fingerprint: Column) -> Column:
    """A string that is equal for equal fingerprints: its size and two 64-bit hashes."""
    return F.lower(F.concat_ws("-", F.size(fingerprint).cast("string"), F.hex(F.xxhash64(fingerprint)), F.hex(F.xxhash64(fingerprint, F.lit(1)))))


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text ends with the beginning of the next document in ascending
    doc_id (null ids first; equal ids in order of their texts; after the last
    comes the first). The key is cut into ranges, so a text is shuffled once;
    over a range's end the next range's first text is joined.
    """
    parts = shuffle_partitions(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_buckets(docs, "doc_id", 4 * parts)
    keyed = docs.withColumn("bucket", bucket_of("doc_id", bounds))
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id"), F.col("text"))).alias("first"))
    # which range comes next: a number for each range, without its text
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    numbers = keyed.select("bucket").distinct()
    numbers = numbers.select(F.col("bucket").alias("before"), F.coalesce(F.lead("bucket").over(around), F.first("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"))
    firsts = numbers.join(firsts.hint("shuffle_hash"), "bucket").select(F.col("before").alias("bucket"), F.col("first.text").alias("after"))
    firsts = add_fingerprint(firsts, "after", "after_print")
    within = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = add_fingerprint(keyed.repartition(parts, "bucket"), "text", "print")
    rows = rows.withColumn("next", F.lead(F.struct("text", "print")).over(within))
    rows = rows.join(firsts.hint("shuffle_hash"), "bucket")
    rows = rows.select("doc_id", "text", "print", F.coalesce(F.col("next.text"), F.col("after")).alias("next_text"), F.coalesce(F.col("next.print"), F.col("after_print")).alias("next_print"), F.length("text").alias("n"))
    cut = F.floor(F.col("n") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = add_fingerprint(rows, "edited", "edited_print").withColumn("own", hashes(F.col("print")))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("print")).alias("fingerprint"),
        digest(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_print"))).alias("near_edited"),
        likeness(F.col("own"), hashes(F.col("next_print"))).alias("near_next"),
        F.size("print").alias("n_marks"),
    )
