"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding. A BPE encoding has one property that makes it a finite-state
relation: the last token of the encoding of a prefix is the one suffix token
``t`` for which the token before it and ``t`` encode to themselves as a pair.
So after each byte it is enough to know, for every position from which a token
may still be pending, the last token there and the tokens not yet emitted.
That is the transducer's state. Whatever all those positions have in common is
emitted; the lookahead is therefore bounded by the longest token. States and
transitions are built the first time an input needs them and kept.

Decoding. Tokens are byte strings; text comes from an incremental UTF-8 state
machine which holds back an unfinished sequence until its next bytes arrive.

Nulls and empty texts give no ids. Repeated rows are encoded alike. Texts are
never cut. Other columns of the input pass through untouched.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.common import row_slices

#: States and remembered segments kept by a worker; beyond that nothing new is kept.
MAX_STATES, MAX_SEGMENTS = 600_000, 900_000
#: Segments that are letters with marks behind, kept besides: they are rebuilt from their parts.
MAX_MARKED = 200_000
#: Bytes of one kept move.
STRIDE = 4
MARKED = re.compile(r"([^\W\d_]+)([^\w\s']+)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.prefixes.add(b"")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: (pending bytes, ((last token, unemitted tokens) for each live position))
        first = (b"", ((-1, ()),))
        self.states = [first]
        self.numbers = {first: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.strides: dict[tuple[int, bytes], tuple[int, tuple[int, ...]]] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self.splits:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.bytes_of)), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def _inner(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that lay at one edge of ``token`` while it was built, each with
        the rank of the merge that ended it (its own last form: no end)."""
        found, end = [], len(self.bytes_of)
        while True:
            found.append((token, end))
            parts = self._split(token)
            if parts is None:
                return found
            token, end = parts[side], token

    def _follows(self, last: int, token: int) -> bool:
        """No merge across the border ever came before the merges inside.

        At a time when ``a`` ends the left token and ``b`` begins the right one,
        the pair would merge if its rank is below the ranks that end a and b
        (on equal ranks the left place goes first).
        """
        known = self.pairs.get((last, token))
        if known is None:
            known = True
            if last >= 0:
                left, right = self._inner(last, 1), self._inner(token, 0)
                i, j = len(left) - 1, len(right) - 1
                while True:
                    (a, a_end), (b, b_end) = left[i], right[j]
                    rank = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
                    if rank is not None and rank < a_end and rank <= b_end:
                        known = False
                        break
                    if i == 0 and j == 0:
                        break
                    if a_end <= b_end:
                        i -= 1
                    else:
                        j -= 1
            self.pairs[last, token] = known
        return known

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        pending, live = self.states[number]
        grown = pending + bytes((byte,))
        n = len(grown)
        for start in range(n):
            token = self.ranks.get(grown[start:])
            if token is not None and self._follows(live[start][0], token):
                live = (*live, (token, (*live[start][1], token)))
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        start = 0
        while grown[start:] not in self.prefixes:
            start += 1
        live, grown = live[start:], grown[start:]
        shared = live[0][1]
        for _, tokens in live[1:]:
            k = 0
            while k < len(shared) and k < len(tokens) and shared[k] == tokens[k]:
                k += 1
            shared = shared[:k]
        k = len(shared)
        state = (grown, tuple((last, tokens[k:]) for last, tokens in live))
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        move = self.moves[number << 8 | byte] = (target, shared)
        return move

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one pre-token.

        Moves over ``STRIDE`` bytes at once are kept as well, as moves of the
        same transducer: most pre-tokens take a few of them.
        """
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        at, moves, strides = 0, self.moves, self.strides
        for k in range(0, len(data), STRIDE):
            piece = data[k : k + STRIDE]
            stride = strides.get((at, piece))
            if stride is None:
                begin, tokens = at, ()
                for byte in piece:
                    move = moves.get(at << 8 | byte) or self._move(at, byte)
                    at = move[0]
                    tokens += move[1]
                if len(strides) < self.max_states:
                    strides[begin, piece] = (at, tokens)
            else:
                at, tokens = stride
            if tokens:
                out += tokens
        out += self.states[at][1][-1][1]
        return out


def _utf8_states() -> list[bytes]:
    """next[state][byte]: 0 between characters, 1 to 3 when so many continuation
    bytes of any value are due, 4 to 7 when the next one is restricted (after E0,
    ED, F0, F4), 8 where no character can go on."""
    bad = 8
    table = [bytearray([bad]) * 256 for _ in range(8)]
    table[0][:0x80] = bytes(0x80)
    for low, high, state in ((0xC2, 0xDF, 1), (0xE1, 0xEC, 2), (0xEE, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        table[0][low : high + 1] = bytes([state]) * (high - low + 1)
    for state, low, high, then in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        table[state][low : high + 1] = bytes([then]) * (high - low + 1)
    return [bytes(row) for row in table]


class Utf8Machine:
    """Incremental UTF-8 as a table of states: text for whatever is complete.

    Every lead byte starts from state 0, so the state after some bytes is known
    from the last of them that is no continuation byte. Bytes that leave a state
    open are held back until the next ones arrive.
    """

    NEXT = _utf8_states()

    def __init__(self):
        self.held = b""

    def _open(self, data: bytes) -> int:
        """Bytes at the end that an unfinished character holds."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for byte in data[len(data) - back :]:
                    state = self.NEXT[state][byte]
                    if state == 8:
                        return 0
                return back if state else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self._open(data)
        self.held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Encoder and decoder for whole texts; remembers segments it has seen.

    A text is cut where a space stands before a visible character. The pattern
    always starts a match there, so segments are independent of each other.
    """

    def __init__(self, path: str, pattern: str, max_segments: int = MAX_SEGMENTS):
        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks)
        self.pattern = regex.compile(pattern)
        self.odd = regex.compile(r" \s| $")
        self.max_segments = max_segments
        self.seen: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.marked = 0
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.decimals = [b"%d" % i for i in range(len(self.tokens))]

    def _segment(self, text: str) -> bytes:
        ids: list[int] = []
        for match in self.pattern.findall(text):
            ids += self.machine.encode(match.encode("utf-8", "surrogatepass"))
        return array("I", ids).tobytes()

    def _learn(self, word: str) -> bytes:
        """Ids of a segment not seen yet (``word`` behind one space)."""
        seen = self.seen
        if word.isalpha():
            ids = array("I", self.machine.encode(b" " + word.encode("utf-8", "surrogatepass"))).tobytes()
        elif (parts := MARKED.fullmatch(word)) and parts[1].isalpha():
            head, marks = parts.groups()  # the pattern always cuts between letters and marks
            ids = (seen.get(head) or self._learn(head)) + self._marks(marks)
            if self.marked >= MAX_MARKED:
                return ids
            self.marked += 1
        else:
            ids = self._segment(" " + word)
        if len(seen) < self.max_segments:
            seen[word] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._segment(marks)
            if len(self.tails) < 10_000:
                self.tails[marks] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.odd.search(text):
            return self._segment(text)
        first, *rest = text.split(" ")
        seen, found = self.seen, [self._segment(first)]
        for word in rest:
            ids = seen.get(word)
            if ids is None:
                ids = self._learn(word)
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_stream(self, ids: list[int], step: int = 8192) -> Iterator[str]:
        """Text pieces; a character split between two steps comes with the later."""
        machine = Utf8Machine()
        for at in range(0, len(ids), step):
            yield machine.feed(self.decode_bytes(ids[at : at + step]))
        yield machine.finish()


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    if (path, pattern) not in _coders:
        # the tables only ever grow and hold no cycles: the collector need not walk them
        gc.disable()
        _coders[path, pattern] = ByteBpe(path, pattern)
    return _coders[path, pattern]


def encode_documents(documents: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``documents`` and the ids of its whole text as array<int>."""
    schema = T.StructType([f for f in documents.schema.fields if f.name != ids] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = coder(path, pattern)
        for part in row_slices(batches, text):
            found = [bpe.encode(t or "") for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(found, pa.list_(pa.int32()))], names=[*names, ids])

    return documents.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` and the text of its ids (null ids: empty)."""
    schema = T.StructType([f for f in encoded.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bpe = coder(path, pattern)
        for part in batches:
            found = ["".join(bpe.decode_stream(x or [])) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(found, pa.string())], names=[*names, text])

    return encoded.mapInArrow(run, schema)


def round_trip_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text; digests of ids and bytes for each document.

    The same coder as above in one pass, so that ids never leave the task.
    ``same_text`` tells whether the streamed text equals the input.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean"

    def run(batches):
        bpe = coder(path, pattern)
        decimal = bpe.decimals.__getitem__
        for part in row_slices(batches, "text"):
            counts, ids_hash, text_hash, same = [], [], [], []
            for t in part.column("text").to_pylist():
                t = t or ""
                ids = bpe.encode(t)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(b" ".join(map(decimal, ids))).hexdigest())
                machine, digest, ok, at = Utf8Machine(), hashlib.sha256(), True, 0
                for k in range(0, len(ids), 8192):
                    data = bpe.decode_bytes(ids[k : k + 8192])
                    digest.update(data)
                    piece = machine.feed(data)
                    ok = ok and t.startswith(piece, at)
                    at += len(piece)
                text_hash.append(digest.hexdigest())
                same.append(ok and at == len(t) and not machine.held)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same_text"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)
