"""A keyed permutation of ``0 .. n - 1`` that needs no table: a Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

from fjordbook.llm.words import mix

ROUNDS = 6


def permute(x: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """Place of each ``x`` in the permutation of ``0 .. n - 1`` chosen by ``key``; ``n`` and ``key`` may differ by row.

    The network permutes the next larger power of four; values that land outside
    are sent through again until they are inside, which keeps it one to one.
    """
    x = np.asarray(x).astype(np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    key = mix(np.broadcast_to(np.asarray(key).astype(np.uint64), x.shape) + np.uint64(0x9E3779B97F4A7C15))
    half = np.ones(x.shape, np.uint64)
    top = n - np.uint64(1)
    while (wide := (half < 32) & ((top >> np.minimum(2 * half, np.uint64(63))) > 0)).any():
        half[wide] += np.uint64(1)
    out, todo = x.copy(), np.arange(x.size)
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right + k + np.uint64((r + 1) * 0xD1B54A32D192ED03 % (1 << 64))) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out
