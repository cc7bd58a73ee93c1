"""Hashes of spans of a byte buffer, eight bytes a turn."""

from __future__ import annotations

import numpy as np
import xxhash

#: Longer spans are hashed one by one.
MOST = 512
KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_A = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_B = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xA0761D6478BD642F))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _turn(state: np.ndarray, lane: np.ndarray, which: int) -> None:
    """Take eight bytes into the states: one to one in the state and in the bytes."""
    state ^= lane
    state *= _A[which]
    state ^= state >> np.uint64(32)
    state *= _B[which]
    state ^= state >> np.uint64(29)


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int = 2) -> list[np.ndarray]:
    """``n`` (1 or 2) 64-bit hashes of every span [lo, hi): chains of mixing steps that share nothing but the bytes.

    Equal bytes hash alike anywhere.  Unlike a polynomial, no family of texts
    collides by its form.
    """
    size = (hi - lo).astype(np.int64)
    order = np.argsort(-np.minimum(size, MOST + 1), kind="stable")
    size, start = size[order], lo[order].astype(np.int64)
    state = [(size.view(np.uint64) + np.uint64(w + 1)) * _A[1 - w] for w in range(n)]
    words = eights(data)
    long = int(np.searchsorted(-size, -MOST, "left")) if len(size) else 0
    for i in range(long):
        x = xxhash.xxh3_128_intdigest(data[start[i] : start[i] + size[i]].tobytes())
        for w in range(n):
            state[w][i] = x >> (64 * w) & (1 << 64) - 1
    at, left, own, k = start[long:], size[long:], [s[long:] for s in state], 0
    falling = -left
    while True:
        m = int(np.searchsorted(falling, -8 * k, "left"))  # those with more than 8 k bytes come first
        if not m:
            break
        lane = words[at[:m] + 8 * k]
        full = int(np.searchsorted(falling, -8 * (k + 1), "right"))
        if full < m:
            lane[full:] &= KEEP[left[full:m] - 8 * k]
        for w in range(n):
            _turn(own[w][:m], lane if w == 0 else (lane << np.uint64(23)) | (lane >> np.uint64(41)), w)
        k += 1
    out = [np.empty(len(order), np.uint64) for _ in range(n)]
    for x, s in zip(out, state, strict=True):
        x[order] = s
    return out
