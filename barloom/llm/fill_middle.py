"""Fill-in-middle: texts cut into prefix, middle and suffix and put in another order.

A batch of texts is one run of bytes. Its line ends (or character starts) are
found by one scan; each text's cuts are the ends that its hash draws. The three
parts of a text keep their bytes and move as blocks, so the displacement of
every byte is a sum of differences: what changes at a part's first byte is
written there, a cumulative sum gives each byte its displacement, and one
scatter puts all bytes of the batch in place. Marks are scattered besides.

Restoring scans a batch of outputs for their marks, finds the parts between
them and gathers the bytes back by the same sums. It needs the output and its
form only.

Null texts count as empty. Empty texts, texts that hold a mark, and the texts
that the rate spares stay plain. A null doc_id draws by the empty string.
Repeated rows give equal outputs. Other columns pass through; columns named
as the new ones are replaced. A text is never cut short: a batch's work space
is some 20 bytes for each byte of its texts, a long text being a batch alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import row_slices

#: Marks before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
WIDTH = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Which of prefix (0), suffix (1) and middle (2) stands first, second and third.
ORDERS = {PSM: (0, 1, 2), SPM: (1, 0, 2)}
#: Bytes of a batch's texts; more only for one longer text.
BATCH = 1_000_000


def draws(seed: int, doc_id: str = "doc_id") -> Column:
    """Four unsigned 32-bit draws of a document, from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))
    return made if len(data) >= 2**31 else made.cast(pa.string())


def unit_ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(places behind each unit, number of units before each text): lines or characters."""
    ends = np.flatnonzero(data == 10) + 1 if unit == "line" else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    ends = np.union1d(ends, offsets[1:][np.diff(offsets) > 0])
    ends = ends[ends > 0]
    return ends, np.searchsorted(ends, offsets, side="right")


def mark_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, which mark, text) of every mark that stands in one text, ascending."""
    at = np.flatnonzero(data[: max(len(data) - WIDTH + 1, 0)] == MARKS[0][0])
    at = at[data[at + WIDTH - 1] == MARKS[0][WIDTH - 1]]
    which = np.full(len(at), -1)
    for n, mark in enumerate(MARKS):
        which[data[at + 1] == mark[1]] = n
    row = np.searchsorted(offsets, at, side="right") - 1
    found = (which >= 0) & (at + WIDTH <= offsets[row + 1])
    return at[found], which[found], row[found]


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Characters of each span of bytes."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[ends] - before[starts]


def displacements(length: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Where each of ``length`` bytes goes, if blocks begin at ``starts`` (ascending,
    empty ones among them) and each block's bytes move by its shift."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, starts, np.diff(shifts, prepend=0))
    return np.cumsum(step[:length]) + np.arange(length)


def rearrange(data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs. ``cuts`` has the two places of each text in
    the bytes, ``forms`` its name; plain texts need cuts at their end."""
    sizes = np.stack([cuts[0] - offsets[:-1], offsets[1:] - cuts[1], cuts[1] - cuts[0]])  # prefix, suffix, middle
    marked = forms != PLAIN
    to = np.concatenate([[0], np.cumsum(np.diff(offsets) + 3 * WIDTH * marked)])
    begin = np.tile(to[:-1], (3, 1))  # of prefix, suffix, middle in the outputs
    out = np.empty(to[-1], np.uint8)
    for form, order in ORDERS.items():
        mine, place = forms == form, to[:-1].copy()
        for part in order:
            for k in range(WIDTH):
                out[place[mine] + k] = MARKS[part][k]
            begin[part, mine] = place[mine] + WIDTH
            place += WIDTH + sizes[part]
    starts = np.stack([offsets[:-1], cuts[0], cuts[1]])
    shifts = np.stack([begin[0], begin[2], begin[1]]) - starts
    out[displacements(len(data), starts.T.ravel(), shifts.T.ravel())] = data
    return out, to


def restore(data: np.ndarray, offsets: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that outputs were made of."""
    marked = forms != PLAIN
    at, which, row = mark_places(data, offsets)
    at, which, row = at[marked[row]], which[marked[row]], row[marked[row]]
    if not np.array_equal(row, np.repeat(np.flatnonzero(marked), 3)):
        raise ValueError("an output that is not plain must hold three marks")
    places, parts = at.reshape(-1, 3), which.reshape(-1, 3)
    if (places[:, 0] != offsets[:-1][marked]).any() or any((parts[forms[marked] == form] != order).any() for form, order in ORDERS.items()):
        raise ValueError("marks do not stand as the form says")
    behind = np.concatenate([places[:, 1:], offsets[1:][marked][:, None]], axis=1)
    slot = np.argsort(parts, axis=1)  # where prefix, suffix and middle stand
    begin = np.take_along_axis(places + WIDTH, slot, axis=1)
    size = np.take_along_axis(behind - places - WIDTH, slot, axis=1)
    to = np.concatenate([[0], np.cumsum(np.diff(offsets) - 3 * WIDTH * marked)])
    starts, sources = np.tile(to[:-1], (3, 1)), np.tile(offsets[:-1], (3, 1))
    starts[1:, ~marked] = to[1:][~marked]  # a plain text is one block; the others are empty
    starts[1, marked] += size[:, 0]
    starts[2, marked] += size[:, 0] + size[:, 2]
    sources[:, marked] = begin[:, [0, 2, 1]].T
    return data[displacements(to[-1], starts.T.ravel(), (sources - starts).T.ravel())], to


def transform(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``documents`` with n (units of the text), form, prefix_chars,
    middle_chars (null if plain) and output.

    ``rate`` of a hundred texts are rearranged, ``spm`` of a hundred of these with
    the suffix first. Cuts are after a drawn number of units, both ends included.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit must be line or char")
    made = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    kept = [f for f in documents.schema.fields if f.name not in made or f.name in (text, doc_id)]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in made.items()])
    if len(set(schema.names)) < len(schema.names):
        raise ValueError(f"text and doc_id cannot be named as a result: {', '.join(made)}")
    kept = [f.name for f in kept]

    def run(batches):
        for part in row_slices(batches, text, BATCH):
            data, offsets = buffer_of(part.column(text))
            drawn = np.array(part.column("_draws").to_pylist(), np.int64).reshape(-1, 4)
            ends, first = unit_ends(data, offsets, unit)
            n = np.diff(first)
            plain = (n == 0) | (drawn[:, 2] % 100 >= rate)
            plain[mark_places(data, offsets)[2]] = True
            forms = np.where(plain, PLAIN, np.where(drawn[:, 3] % 100 < spm, SPM, PSM))
            units = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1).T
            behind = np.concatenate([ends, [len(data)]])
            cuts = np.where(units > 0, behind[np.minimum(first[:-1] + np.maximum(units, 1) - 1, len(ends))], offsets[:-1])
            cuts = np.where(plain, offsets[1:], cuts)
            out, to = rearrange(data, offsets, cuts, forms)
            chars = [pa.array(code_points(data, a, b), mask=plain) for a, b in ((offsets[:-1], cuts[0]), (cuts[0], cuts[1]))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(n), pa.array(forms.tolist(), pa.string()), *chars, strings_of(out, to)], names=schema.names)

    return documents.select(*kept, draws(seed, doc_id).alias("_draws")).mapInArrow(run, schema)


def restore_texts(transformed: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """All columns of ``transformed`` and the text of each output (null: empty)."""
    schema = T.StructType([f for f in transformed.schema.fields if f.name != restored] + [T.StructField(restored, T.StringType())])
    names = schema.names[:-1]

    def run(batches):
        for part in row_slices(batches, output, BATCH):
            data, offsets = buffer_of(part.column(output))
            forms = np.array(part.column(form).fill_null(PLAIN).to_pylist(), object)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], strings_of(*restore(data, offsets, forms))], names=schema.names)

    return transformed.select(*names).mapInArrow(run, schema)


def digests(documents: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form, parts' characters and the digests of output and restored text."""
    both = restore_texts(transform(documents.select("doc_id", "text"), seed, rate, spm).drop("text"))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
