"""Shingle sets of texts and their fast similarity sketches.

The sketch has T coordinates. In round i every element of a set falls into one bin by a
hash of its own and competes there with value i + hash in [0, 1); in rounds T to 2T - 1
all elements compete for bin i - T. A bin keeps the smallest value ever seen. Rounds end
once all bins are filled, so a set of n elements needs about max(1, T log T / n) rounds,
and after 2T no bin can be empty. Two sets agree in a bin with probability their
similarity, and the number of agreeing bins is concentrated as for independent ones.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; each seed is another hash function."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(33)) * _M1
        x = (x ^ x >> np.uint64(33)) * _M2
        return x ^ x >> np.uint64(33)


def shingles(text: str, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; of fewer words, of all in one."""
    words = text.encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, 0x9E3779B97F4A7C15 + size, np.uint64)
        for i in range(size):
            out = (out ^ h[i : n - size + 1 + i]) * _M1
            out ^= out >> np.uint64(29)
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """The sketch of each set, a row of t numbers each; an empty set's row is all ones."""
    n = len(sets)
    out = np.full(n * t, 0xFFFFFFFFFFFFFFFF, np.uint64)
    if not n:
        return out.reshape(0, t)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    item = np.concatenate(sets)
    for turn in range(2 * t):
        if not len(item):
            break
        value = mixed(item, 2 * turn)
        # A round's values lie above those of earlier rounds: only empty bins change. The low
        # bit says that a bin is filled, the rest of the number tells elements and rounds apart.
        at = row * t + (mixed(item, 2 * turn + 1) % np.uint64(t)).astype(np.int64) if turn < t else row * t + (turn - t)
        empty = out[at] == 0xFFFFFFFFFFFFFFFF
        at, value = at[empty], value[empty] >> np.uint64(1)
        np.minimum.at(out, at, value)
        if turn == 0 or turn % 4 == 3:
            open_ = (out.reshape(n, t) == 0xFFFFFFFFFFFFFFFF).any(axis=1)
            stay = open_[row]
            row, item = row[stay], item[stay]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band of ``rows`` coordinates, as signed longs; keys of other bands differ."""
    n = len(sketch)
    part = sketch[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M2, (n, bands)).copy()
        for i in range(rows):
            out = (out ^ part[:, :, i]) * _M1
            out ^= out >> np.uint64(31)
    return out.view(np.int64)
