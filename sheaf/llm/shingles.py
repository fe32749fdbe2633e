"""Word shingles of whole texts as sorted arrays of 64-bit hashes, in numpy.

A word's hash is the polynomial of its bytes, taken for all words at once from running
sums; a shingle's hash mixes those of its words by place. Two different shingles agree
with probability 2**-64.
"""

from __future__ import annotations

import functools

import numpy as np

#: Odd 64-bit numbers with well-mixed bits; any others would do.
_BASE = 0x9E3779B97F4A7C15
_ROUND = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[ord("A") : ord("Z") + 1] += 32


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, by doubling."""
    out = np.ones(1, dtype="u8")
    step = base % (1 << 64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_ROUND[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_ROUND[1])
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: np.ndarray) -> np.ndarray:
    """A hash per word of a text given as bytes."""
    space = _SPACE[text]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype("i1")))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype="u8")
    n = 1 << max(12, int(len(text)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[text].astype("u8") + np.uint64(1)) * _powers(_BASE, n)[: len(text)])])
    # Divided by base**start, so that a word hashes alike wherever it stands.
    inverse = pow(_BASE, -1, 1 << 64)
    return mix((sums[ends] - sums[starts]) * _powers(inverse, n)[starts] + (ends - starts).astype("u8"))


_BLOCK = 1 << 20


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word; very long texts are taken in stretches that end between words."""
    data = np.frombuffer(text, dtype="u1")
    if len(data) <= _BLOCK:
        return _word_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _BLOCK)
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + _BLOCK)
        parts.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lower-cased.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    return np.unique(shingles(text, words))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's shingles, in the order of the text."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    total = np.full(n, width, dtype="u8")
    for k in range(width):
        total = mix(total * np.uint64(_BASE) + hashes[k : k + n])
    return total
