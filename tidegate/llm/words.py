"""Hashes of words and of windows of words, computed over whole texts with numpy.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. A word's hash is a polynomial over its
bytes modulo 2**64, mixed; a window's hash is a polynomial over the hashes of its words, mixed
with its width. Both come from running sums, so their cost does not depend on the width.
Different words or windows share a hash with a probability of about 2**-64.
"""

import numpy as np

from tidegate.llm.process import kept

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(value: int) -> np.uint64:
    return mix(np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def _byte_values() -> np.ndarray:
    return kept("byte values", lambda: mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP)))


def _spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _is_space() -> np.ndarray:
    return kept("spaces", _spaces)


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for factor in (base, pow(base, -1, 1 << 64)):
        values = np.full(size, factor, np.uint64)
        values[0] = 1
        found.append(np.multiply.accumulate(values))
    return found[0], found[1]


def _table(base: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(needed).bit_length())
    if size > 4 * PIECE:
        return _powers(base, size)
    return kept(("powers", base, size), lambda: _powers(base, size))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, as byte positions."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_is_space()[np.frombuffer(data, np.uint8)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """One hash per word; long texts are read in pieces that end between words."""
    if len(data) <= PIECE:
        return _word_hashes(data)
    spaces = _is_space()
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not spaces[data[end]]:
            end += 1
        parts.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def _word_hashes(data: bytes) -> np.ndarray:
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    powers, inverse = _table(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[np.frombuffer(data, np.uint8)] * powers[: len(data)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(found + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, by its first word."""
    count = len(words) - width + 1
    if count <= 0 or width <= 0:
        return np.empty(0, np.uint64)
    powers, inverse = _table(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    found = (sums[width:] - sums[:count]) * inverse[:count]
    return mix(found ^ mix_one(width))


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span of words, of any lengths."""
    powers, inverse = _table(_STEP, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(found ^ mix((ends - starts).astype(np.uint64)))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct windows, sorted; the whole sequence if there are fewer words; else empty."""
    if not len(words):
        return np.empty(0, np.uint64)
    found = np.sort(window_hashes(words, min(width, len(words))))
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]
