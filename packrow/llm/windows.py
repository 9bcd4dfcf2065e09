"""Hashes of word windows, and the anchors that stand for them.

A window of ``SIZE`` words is represented by its anchor: the one of its ``GRAM``-word sequences with the
smallest hash (the first of equal ones). Equal windows have equal anchors, and neighbouring windows
mostly share one, so an index of anchors is several times smaller than one of windows and misses none.
"""

from __future__ import annotations

import numpy as np
import xxhash

SIZE, GRAM = 20, 6
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """Hash of a sequence from the hash of its first ``shift`` words and that of the rest."""
    n = max(0, len(b) - shift)
    return _mix(a[:n] * _A + b[shift : shift + n] + np.uint64(shift))


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each GRAM-word sequence, hash of each SIZE-word window), both by their first word."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    two = _joined(one, one, 1)
    four = _joined(two, two, 2)
    eight = _joined(four, four, 4)
    sixteen = _joined(eight, eight, 8)
    return _joined(four, two, 4), _joined(sixteen, four, 16)


def anchors(grams: np.ndarray, n_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window, anchor's place) of each stretch of windows that share their anchor."""
    span = SIZE - GRAM + 1
    best, at = grams[:n_windows].copy(), np.zeros(n_windows, np.int64)
    for k in range(1, span):
        later = grams[k : k + n_windows]
        less = later < best
        np.copyto(best, later, where=less)
        at[less] = k
    at += np.arange(n_windows)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, at[first]


def context(windows: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A hash of all words of each stretch of ``count`` windows (its first and last window cover it)."""
    return _mix(windows[first] * _A + windows[first + count - 1] * _B + count.astype(np.uint64))
