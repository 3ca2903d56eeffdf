"""SetSketch registers over shingle sets, and what two sketches say of their sets.

Every element of a set gives each of M registers an exponentially distributed
value by its hash; a register keeps the least, stored as a truncated logarithm
to base BASE in one byte. Registers of a union are the elementwise maxima of
the stored bytes, and two sets agree in a register with a chance near their
Jaccard similarity. An element's values are drawn in ascending order, so a set
stops drawing once no further value can matter.
"""

from __future__ import annotations

import numpy as np

from brandloom.llm.wordhash import LOWER, SPACE, mix, words

#: Bands of ROWS registers each; a prime number of registers, so that any step
#: walks through all of them.
ROWS, BANDS = 6, 40
REGISTERS = 241
BASE, RATE = 1.1, 20.0

_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (row, 64-bit hash), sorted by both.

    Words are lower-cased (A-Z) runs between ASCII white space. A text of
    fewer than `size` words, but not none, has one shingle: all its words.
    """
    w = words(LOWER[data], offsets, SPACE)
    if not len(w.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.bincount(w.row, minlength=len(offsets) - 1)
    length = np.minimum(n, size)[w.row]  # of the shingle that starts at each word
    place = np.arange(len(w.row)) - np.repeat(np.cumsum(n) - n, n)
    starts = np.flatnonzero(place + length <= n[w.row])
    with np.errstate(over="ignore"):
        h = length[starts].astype(np.uint64)
        for k in range(size):
            there = starts[length[starts] > k]
            step = mix(h[length[starts] > k] * _U(0x9E3779B97F4A7C15) + w.hashes[there + k])
            h[length[starts] > k] = step
    row = w.row[starts]
    ends = np.cumsum(np.bincount(row, minlength=len(offsets) - 1)).tolist()
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def sketches(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """rows x REGISTERS stored bytes; 0 throughout for a set without elements."""
    least = np.full((rows, REGISTERS), np.inf)
    flat = least.ravel()
    with np.errstate(over="ignore"):
        state = mix(hashes + _U(0x632BE59BD9B4E019))
        at = (state % _U(REGISTERS)).astype(np.int64)
        step = (mix(state) % _U(REGISTERS - 1)).astype(np.int64) + 1
        own, value = row, np.zeros(len(row))
        for drawn in range(REGISTERS):
            state = mix(state + _U(0x9E3779B97F4A7C15))
            value = value - np.log(((state >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (REGISTERS - drawn)
            np.minimum.at(flat, own * REGISTERS + at, value)
            alive = value < least.max(1)[own]
            if not alive.any():
                break
            own, value, state, at, step = own[alive], value[alive], state[alive], at[alive], step[alive]
            at = (at + step) % REGISTERS
    with np.errstate(divide="ignore"):
        stored = np.floor(1 - (np.log(least) - np.log(RATE)) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, stored), 0, 255).astype(np.uint8)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 24) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches of known set sizes.

    The counts of registers where a is larger, b is larger, and both agree
    have chances that depend on the similarity j alone once the sizes are
    known; the likelihood is unimodal in j and its top is found by ternary
    search between 0 and the most that the sizes allow.
    """
    more = (a > b).sum(1).astype(float)
    less = (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(a)), np.minimum(u, v) / np.maximum(u, v)
    for _ in range(steps):
        one, two = low + (high - low) / 3, high - (high - low) / 3
        left = log_likelihood(one) > log_likelihood(two)
        high, low = np.where(left, two, high), np.where(left, low, one)
    return (low + high) / 2
