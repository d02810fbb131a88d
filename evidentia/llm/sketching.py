"""Fast similarity sketches of word-shingle sets, vectorised over a batch of documents.

A sketch has ``t`` coordinates.  In round ``i`` every element of a set is hashed to a bin and a value in
``[i, i + 1)``; a coordinate keeps the smallest value that reached its bin.  Rounds ``1..t`` pick the bin at
random, rounds ``t + 1..2t`` send every element to bin ``i - t``, so after ``2t`` rounds each coordinate is
filled whatever the set; a set stops as soon as all its coordinates are.  Two sets agree in a coordinate with
probability equal to their Jaccard similarity, and, unlike plain one-permutation hashing, the number of agreeing
coordinates is concentrated as in ``t`` independent draws.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
CHUNK = 1 << 22  # bytes of a text that are split into words at once


class WordHasher(dict):
    """64 bits of a keyed digest (BLAKE2b) for each word of a text; those of the last ``most`` words are kept."""

    def __init__(self, most: int = 500_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found

    def of(self, text: str | None) -> np.ndarray:
        """One hash for each word: runs of bytes other than ASCII white space, with A-Z lowered."""
        raw, at, out = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
        while at < len(raw):
            cut = _SPACE.search(raw, at + CHUNK) if at + CHUNK < len(raw) else None
            end = cut.start() if cut else len(raw)
            words = raw[at:end].split()
            out.append(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int, hasher: WordHasher) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles.

    A text of fewer than k words has its whole word sequence as one shingle; no text, or none but white space, gives the
    empty set.  Two shingles of which only one word differs never share a hash (each step is a bijection); others do with
    a probability of 2**-64, so comparing two sets of n errs with about n * n * 2**-64.
    """
    h = hasher.of(text)
    if not len(h):
        return h
    width = min(k, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(width))
        for j in range(width):
            s = mix64(s * _STEP + h[j : j + n])
    s.sort()
    return s[np.diff(s, prepend=~s[:1]) != 0]


def sketch(sets: list[np.ndarray], t: int, seed: int = 0) -> np.ndarray:
    """A ``len(sets) x t`` matrix of coordinates; empty sets get rows of zeros."""
    out = np.zeros((len(sets), t), np.uint64)
    todo = [i for i, s in enumerate(sets) if len(s)]
    if not todo:
        return out
    least = np.full((len(todo), t), np.iinfo(np.uint64).max, np.uint64)
    flat, owner = np.concatenate([sets[i] for i in todo]), np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
    open_rows = np.ones(len(todo), bool)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            h = mix64(flat + mix64(np.uint64([seed * 1_000_003 + i + 1]))[0])
            b = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
            # the round in the high bits: a value of an earlier round is smaller than any of a later one
            np.minimum.at(least.reshape(-1), owner * t + b, (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16)))
            if i % 4 == 3 or i < 2:
                open_rows = (least == np.iinfo(np.uint64).max).any(1)
                if not open_rows.any():
                    break
                keep = open_rows[owner]
                if not keep.all():
                    flat, owner = flat[keep], owner[keep]
    out[todo] = least
    return out


def band_keys(coords: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    n, t = coords.shape
    bands = t // rows
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
        for j in range(rows):
            key = mix64(key * np.uint64(31) + coords[:, j : bands * rows : rows])
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
