"""numpy kernels over the UTF-8 buffer of an Arrow string column.

Words are runs of bytes, found with table look-ups, and are represented by
64-bit hashes: the sum of a pseudo-random number for each byte at its place in
the word, taken from one running sum.  So the cost per byte is a few vector
operations and no Python object is made per word; and as the numbers have no
structure, no pattern of bytes makes two words collide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Places of a word whose numbers are in a table; those beyond are computed.
_PLACES = 64
with np.errstate(over="ignore"):
    _numbers = mix(mix(np.arange(_PLACES * 257, dtype=U64) + U64(0x51ED2701)) ^ U64(0x2545F4914F6CDD1D))


def _byte_numbers(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for each byte code at its place."""
    at = place * 257 + code
    out = _numbers[np.minimum(at, len(_numbers) - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        out[far] = mix(mix(at[far].astype(U64) + U64(0x51ED2701)) ^ U64(0x2545F4914F6CDD1D))
    return out


def _table(separators) -> np.ndarray:
    """Byte -> code: 0 for separators, else 1 + the byte with A-Z lower-cased."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
ALNUM = _table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = _table([0x20, *range(0x09, 0x0E)])


@dataclass
class Words:
    """Words of a run of texts: hashes, byte ranges, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64))
    code = table[data]
    inside = code != 0
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # texts never share a word
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:n])
    change |= first
    edges = np.flatnonzero(change)
    runs = inside[edges[:-1]]
    starts, ends = edges[:-1][runs], edges[1:][runs]
    size = ends - starts
    before = np.cumsum(size) - size
    letters = code[inside]
    place = np.arange(len(letters)) - np.repeat(before, size)
    total = np.zeros(len(letters) + 1, U64)
    np.cumsum(_byte_numbers(letters, place), out=total[1:])
    hashes = mix(total[before + size] - total[before] + size.astype(U64) * _GOLD)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def segment_ids(offsets: np.ndarray) -> np.ndarray:
    """The segment of each element: 0 0 0 1 1 ..."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive elements, len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    q = U64((0xD6E8FEB86659FD93 + 2 * seed) | 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= q
        out += hashes[j : j + n]
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-word shingles of each text: hashes, word index, offsets by text.

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    counts = words.counts
    n = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], n)
    padded = np.concatenate([words.hashes, np.zeros(k, U64)])
    out = rolling(padded, k)[at] if len(at) else np.zeros(0, U64)
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hashes[words.offsets[d] : words.offsets[d + 1]]
        out[offsets[d]] = rolling(own, len(own), seed=len(own))[0]
    return out, at, offsets


def sequence_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each segment's whole sequence: sums over elements at their places."""
    n = len(hashes)
    size = np.diff(offsets)
    place = (np.arange(n) - np.repeat(offsets[:-1], size)).astype(U64)
    out = []
    for salt in (U64(0), U64(0xA5A5A5A5DEADBEEF)):
        total = np.zeros(n + 1, U64)
        np.cumsum(mix(mix(hashes ^ salt) + place * _GOLD), out=total[1:])
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(U64) * _GOLD + salt))
    return out[0], out[1]


def occurrence_labels(values: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """How often each value came before in its segment."""
    key = mix(values + (segments.astype(U64) + U64(1)) * _GOLD)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(key))
    first = np.maximum.accumulate(np.where(fresh, at, 0))
    out = np.empty(len(key), np.int64)
    out[order] = at - first
    return out
