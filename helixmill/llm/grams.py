"""Vectorised words and word n-grams over batches of UTF-8 text.

Words are found and hashed on raw bytes: every delimiter of the supported
patterns is ASCII, so byte classes and code-point classes agree. A word's hash
is a 64-bit polynomial over its bytes followed by a mixing step.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: A-Z to a-z, all other bytes kept.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(delimiters) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(delimiters)] = False
    return table


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = _class([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: [^\x20\x09-\x0D]
NOT_SPACE = _class([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words(NamedTuple):
    hashes: np.ndarray  # one per word, in text order
    starts: np.ndarray  # byte offsets
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word; one more than documents


def words(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """The words of documents raw[at[i]:at[i+1]], A-Z lower-cased."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), z, z, np.zeros(len(at), np.int64))
    low = LOWER[raw]
    inside = kind[low]
    edge = np.zeros(n + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    if cuts[-1] != n:
        cuts = np.append(cuts, n)
    if cuts[0] != 0:
        cuts = np.insert(cuts, 0, 0)
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * power[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(h, starts, ends, np.searchsorted(starts, at))


def constants(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes, document borders ignored."""
    if len(h) < k:
        return np.zeros(0, U)
    n = len(h) - k + 1
    out = np.zeros(n, U)
    for j, c in enumerate(constants(k)):
        out += h[j : j + n] * c
    return mix(out)


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document index of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def room(first: np.ndarray) -> np.ndarray:
    """Words from each word to its document's end, itself included."""
    n = int(first[-1])
    return np.repeat(first[1:], np.diff(first)) - np.arange(n)


class Index:
    """Sorted multimap from hashes to row numbers, with a bit table in front."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bits = max(12, int(len(keys)).bit_length() + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(keys >> U(64 - self.bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, row) for every match."""
        at = np.flatnonzero(self.seen[(h >> U(64 - self.bits)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.order[np.repeat(lo, n) + each]
