"""SentencePiece BPE by a table of last tokens, without running any merges.

Whatever text stands before a place, the encoding up to there ends in exactly
one token ``t``: the one for which the encoding up to ``t`` ends in a token
that goes with ``t`` as a pair. So a table of one token for each prefix is
filled from left to right: an Aho-Corasick automaton gives the pieces that end
at a place, a pair test picks the one that fits, and the ids are read off the
table backwards, from the end of the text.

The pair test looks at the merges inside both pieces: a pair is apart in an
encoding if no merge across its border would have come before the merge that
ended the left edge or the right one. Equal scores merge from the left.

White space is escaped as U+2581 with one put in front of the text; characters
without a piece become their bytes. A text is cut where no piece can reach
across: before a run of U+2581 and around line ends, if the model has no piece
that crosses there.

Nulls and empty texts give no ids. Repeated rows are encoded alike. Texts are
never cut short. Other columns of the input pass through untouched.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.common import row_slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Segments and pair tests kept by a worker; segments beyond are encoded each time, pairs are dropped and tested anew.
MAX_SEGMENTS, MAX_PAIRS = 900_000, 3_000_000


class PieceModel:
    """What encoding needs of a model file: pieces, ranks of scores, byte ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as layout

        with open(path, "rb") as file:
            model = layout.ModelProto.FromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != layout.TrainerSpec.BPE or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep the text and put white space in front")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.names = [p.piece for p in model.pieces]
        places = {s: n for n, s in enumerate(sorted({model.pieces[i].score for i in self.ids.values()}, reverse=True))}
        #: Best score first; equal scores share a rank.
        self.ranks = {p: places[model.pieces[i].score] for p, i in self.ids.items()}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        if len(self.byte_ids) != 256:
            raise ValueError("only models with a piece for each byte")
        self.bare = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        surface = {NORMAL: lambda p: p.piece.replace(SPACE, " ").encode(), UNKNOWN: lambda p: (model.trainer_spec.unk_surface or " ⁇ ").encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p.piece[1:-1], 16)])}
        self.surfaces = [surface[p.type](p) for p in model.pieces]


class PairTest:
    """Which two pieces may stand side by side in an encoding."""

    def __init__(self, model: PieceModel):
        self.model, self.never = model, len(model.ranks)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[tuple[int, int], bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two pieces whose merge ends ``token``; None for one character, and
        (-1, -1) for a piece that its own text is not encoded to."""
        if token not in self.parts:
            ranks, parts = self.model.ranks, list(self.model.names[token])
            while len(parts) > 2:
                rank, at = min((ranks.get(a + b, self.never), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == self.never:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ids = [self.model.ids.get(p, -1) for p in parts]
            self.parts[token] = None if len(ids) == 1 else (ids[0], ids[1]) if len(ids) == 2 and -1 not in ids else (-1, -1)
        return self.parts[token]

    def edge(self, token: int, side: int) -> list[tuple[str, int]]:
        """Texts that stood at one edge while ``token`` was built, smallest first,
        each with the rank of the merge that ended it."""
        found = self.edges[side].get(token)
        if found is None:
            halves = self.halves(token)
            inner = [] if halves is None else self.edge(halves[side], side)
            if inner:
                inner = [*inner[:-1], (inner[-1][0], self.model.ranks[self.model.names[token]])]
            found = self.edges[side][token] = [*inner, (self.model.names[token], self.never)]
        return found

    def alone(self, token: int) -> bool:
        return self.halves(token) != (-1, -1)

    def test(self, left: int, right: int) -> bool:
        ranks, a_edge, b_edge = self.model.ranks, self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = a_edge[i], b_edge[j]
            rank = ranks.get(a + b)
            if rank is not None and rank < a_end and rank <= b_end:
                return False  # the border would have merged first
            if i + 1 == len(a_edge) and j + 1 == len(b_edge):
                return True
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def __call__(self, left: int, right: int) -> bool:
        fits = self.known.get((left, right))
        if fits is None:
            if len(self.known) >= MAX_PAIRS:
                self.known.clear()
            fits = self.known[left, right] = self.test(left, right)
        return fits


class Segments(dict):
    """Ids of segments as bytes; a missing one is encoded when asked for."""

    def __init__(self, model: PieceModel, most: int):
        import ahocorasick

        super().__init__()
        self.model, self.most, self.fits = model, most, PairTest(model)
        self.lengths = [len(p) for p in model.names]
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            if self.fits.alone(i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix's encoding; -1 after a character without a piece."""
        last, fits = [-1] * (len(text) + 1), self.fits
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                if before < 0 or fits(before, token):
                    last[end] = token
        return last

    def encode(self, text: str) -> list[int]:
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            token = last[at]
            if token < 0:
                out += [self.model.byte_ids[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.lengths[token]
        out.reverse()
        return out

    def __missing__(self, text: str) -> bytes:
        ids = array("I", self.encode(text)).tobytes()
        if len(self) < self.most:
            self[text] = ids
        return ids


class PieceBpe:
    """Encoder and decoder for whole texts; remembers segments it has seen."""

    def __init__(self, path: str, max_segments: int = MAX_SEGMENTS):
        self.model = PieceModel(path)
        self.segments = Segments(self.model, max_segments)
        inside = self.model.ids
        line = "" if any("\n" in p for p in inside) else "\n"
        if any(SPACE in p.lstrip(SPACE) for p in inside):
            self.cut = re.compile(f"[^{line}]+|[{line}]" if line else ".+", re.DOTALL).findall
        else:
            self.cut = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + f"|{line}" * bool(line)).findall
        self.decimals = [b"%d" % i for i in range(len(self.model.names))]

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.segments.__getitem__, self.cut(SPACE + text.replace(" ", SPACE))))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space in front goes, control ids have no text, a byte
        that belongs to no character is U+FFFD."""
        data = b"".join(map(self.model.surfaces.__getitem__, ids))
        first = next((i for i in ids if i not in self.model.bare), None)
        if first is not None and self.model.names[first].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _each_bad_byte(data)


def _each_bad_byte(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out.append(data[at : at + bad.start].decode() + "�")
            at += bad.start + 1
    return "".join(out)


_coders: dict[str, PieceBpe] = {}


def coder(path: str) -> PieceBpe:
    """One coder for each worker process."""
    if path not in _coders:
        _coders[path] = PieceBpe(path)
        gc.freeze()  # the model's tables hold no cycles: the collector need not walk them
    return _coders[path]


def encode_documents(documents: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``documents`` and the ids of its whole text as array<int>."""
    schema = T.StructType([f for f in documents.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = coder(path)
        for part in row_slices(batches, text):
            runs = [np.frombuffer(bpe.encode_bytes(t), "<i4") for t in part.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, runs)]).astype("int32")
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*runs, np.empty(0, "<i4")])))
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [made], names=[*names, ids])

    return documents.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text of its ids (null ids: empty)."""
    schema = T.StructType([f for f in encoded.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = coder(path)
        for part in batches:
            found = [bpe.decode(x or []) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(found, pa.string())], names=[*names, text])

    return encoded.mapInArrow(run, schema)


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text.

    The same coder as above in one pass, so that ids never leave the task.
    ``same_text`` tells whether the decoded text equals the input.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"

    def run(batches):
        bpe = coder(path)
        decimal = bpe.decimals.__getitem__
        for part in row_slices(batches, "text"):
            counts, ids_hash, text_hash, same = [], [], [], []
            for t in part.column("text").to_pylist():
                ids = bpe.encode(t)
                decoded = bpe.decode(ids)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == (t or ""))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same_text"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
