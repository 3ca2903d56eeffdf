"""Vectorised words and 64-bit hashes over the bytes of many texts at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random uint64."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_BYTE = seeded(256, 7)
_STEP = _U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    row: np.ndarray  # the text that holds it
    start: np.ndarray  # its first byte in the joined texts
    length: np.ndarray  # in bytes


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _STEP
        np.cumprod(out, out=out)
    return out


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Runs of bytes outside `separator`, text by text, with their hashes.

    Two words have the same hash if they are equal; different ones collide
    with a chance near 2**-60, as every byte has a random 64-bit value.
    """
    inside = ~separator[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] |= inside[heads]
    start = np.flatnonzero(first)
    packed = np.flatnonzero(inside)
    at = np.searchsorted(packed, start)
    length = np.diff(np.append(at, len(packed)))
    place = np.arange(len(packed)) - np.repeat(at, length)
    with np.errstate(over="ignore"):
        value = _BYTE[data[packed]] * _powers(int(length.max()))[place]
        hashes = mix(np.add.reduceat(value, at) + length.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(hashes, row, start, length)
