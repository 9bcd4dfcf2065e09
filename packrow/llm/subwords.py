"""Hashed features of words: the word itself and its character n-grams, vectorised over many words."""

from __future__ import annotations

import numpy as np

NGRAMS = (2, 3, 4)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MUL
    return x ^ (x >> np.uint64(32))


def features(words: list[bytes], buckets: int, ngrams: tuple[int, ...] = NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature id) pairs: each word with its boundaries, and its n-grams of bytes.

    The whole word's feature is the polynomial hash of all its bytes. A word of any length is
    covered; its cost is linear in its bytes.
    """
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.cumsum(lengths)
    place = np.arange(len(joined), dtype=np.int64) - np.repeat(ends - lengths, lengths)
    whole = np.add.reduceat(_mix(joined * _MUL + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), ends - lengths) if len(words) else np.zeros(0, np.uint64)
    who, what = [np.arange(len(words))], [_mix(whole) % np.uint64(buckets)]
    rolled = joined.copy()
    for n in range(2, max(ngrams) + 1):
        rolled = rolled[:-1] * np.uint64(1000003) + joined[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in ngrams and len(rolled):
            inside = owner[: len(rolled)] == owner[n - 1 :]
            who.append(owner[: len(rolled)][inside])
            what.append(_mix(rolled[inside] + np.uint64(n)) % np.uint64(buckets))
    return np.concatenate(who), np.concatenate(what).astype(np.int64)
