"""Simple-8b: as many ids in each 64-bit word as one common width allows.

The upper 4 bits of a word select how many values share the lower 60 bits.
Selector 15 is the escape: its 60 bits are the place of a value in a side list
of full 64-bit values, for values that need more than 60 bits. Words stand
little-endian; a run of values always begins with a new word, so a reader can
start at any run's word offset and decode all words of a selector at once.
"""

from __future__ import annotations

import numpy as np

#: Values in a word and bits of each, by selector. Fixed values of the format.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
LOW = np.uint64((1 << 60) - 1)


def pack(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word offset of each run, and the escaped values.

    ``starts`` are the ascending first places of runs in ``values``; a word
    never holds values of two runs. Empty runs take no words.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), np.zeros(0, np.uint64)
    narrow = np.repeat(np.arange(len(WIDTHS), dtype=np.uint8), np.diff(np.append(0, 1 << np.minimum(WIDTHS, 16))))  # class of values below 2^16
    bits = narrow[np.minimum(values, np.uint64(65535)).astype(np.int64)]
    large = np.flatnonzero(values > np.uint64(65535))
    bits[large] = np.searchsorted((np.uint64(1) << WIDTHS.astype(np.uint64)) - np.uint64(1), values[large]).astype(np.uint8)
    run_end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    best = np.full(n, len(COUNTS), np.uint8)
    most, reach = bits.copy(), 1  # widest class among the next `reach` values
    for s in range(len(COUNTS) - 1, -1, -1):  # what fits a fuller word also fits all wider ones
        count = int(COUNTS[s])
        while reach < count:
            step = min(reach, count - reach)
            np.maximum(most[: max(0, n - step)], most[step:], out=most[: max(0, n - step)])
            reach += step
        fits = most <= s
        if not fits.any():
            break
        best -= fits
    take = np.minimum(np.append(COUNTS, 1)[best], run_end - np.arange(n))  # a run's last word may be filled up with zeros
    steps, at, places = take.tolist(), 0, []
    while at < n:
        places.append(at)
        at += steps[at]
    at = np.array(places, np.int64)
    chosen = best[at].astype(np.int64)
    chosen[chosen == len(COUNTS)] = ESCAPE
    words = np.zeros(len(at), np.uint64)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for s in range(len(COUNTS)):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            count, width = int(COUNTS[s]), int(WIDTHS[s])
            place = at[rows, None] + np.arange(count)
            held = padded[place]
            short = np.flatnonzero(at[rows] + count > run_end[at[rows]])
            held[short] = np.where(place[short] < run_end[at[rows[short]], None], held[short], np.uint64(0))
            word = np.bitwise_or.reduce(held << (np.arange(count, dtype=np.uint64) * np.uint64(width)), axis=1)
            words[rows] = word | np.uint64(s << 60)
    escapes = np.flatnonzero(chosen == ESCAPE)
    words[escapes] = np.arange(len(escapes), dtype=np.uint64) | np.uint64(ESCAPE << 60)
    return words, np.searchsorted(at, starts), values[at[escapes]]


def unpack(words: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """All values, run after run; ``sizes`` are the runs' value counts."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.append(COUNTS, [1, 1])[selector]
    ends = np.append(offsets[1:], len(words))
    filled = np.cumsum(np.append(0, held))
    for i in np.flatnonzero(sizes > 0):  # the last word of a run may hold fewer
        held[ends[i] - 1] -= filled[ends[i]] - filled[offsets[i]] - sizes[i]
    first = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), np.uint64)
    for s in range(len(COUNTS)):
        rows = np.flatnonzero(selector == s)
        if len(rows):
            count, width = int(COUNTS[s]), int(WIDTHS[s])
            values = (words[rows, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & np.uint64((1 << width) - 1)
            inside = np.arange(count) < held[rows, None]
            out[(first[rows, None] + np.arange(count))[inside]] = values[inside]
    rows = np.flatnonzero(selector == ESCAPE)
    if len(rows):
        out[first[rows]] = escaped[(words[rows] & LOW).astype(np.int64)]
    return out
