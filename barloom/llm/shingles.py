"""Hashed word shingles and minwise signatures of many texts at once."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers: one for each word of a shingle, drawn from the rule below.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, cut at ASCII white space), words by text."""
    coded = [(t or "").encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    space = _SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    starts = np.flatnonzero(start)
    ends = np.cumsum([len(c) for c in coded])
    counts = np.diff(np.append(0, np.searchsorted(starts, ends)))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    inside = np.flatnonzero(~space)
    lengths = np.diff(np.append(np.searchsorted(inside, starts), len(inside)))
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        terms = (data[inside].astype(np.uint64) + np.uint64(1)) * drawn(int(lengths.max()), 1)[place]
        return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    A text of fewer words is one shingle; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    factors = drawn(width, 2) | np.uint64(1)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for k in range(min(width, n)):
            rolled[: n - k] += hashes[k:] * factors[k]
        rolled = mixed(rolled)
        out, at = [], 0
        for c in counts.tolist():
            if c >= width:
                out.append(np.unique(rolled[at : at + c - width + 1]))
            elif c:
                out.append(mixed(np.array([(hashes[at : at + c] * factors[:c]).sum() + np.uint64(c)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
    return out


def signature(shingles: np.ndarray, size: int, bits: int = 16) -> np.ndarray:
    """``size`` minwise values, the low ``bits`` of each (b-bit signature)."""
    factors, shifts = drawn(size, 3) | np.uint64(1), drawn(size, 4)
    out = np.empty(size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out[k] = (shingles * factors[k] + shifts[k]).min()
        # the minimum's upper bits are mostly zero: mix before taking bits
        return (mixed(out) & np.uint64((1 << bits) - 1)).astype(np.uint16)
