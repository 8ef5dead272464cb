"""Polynomial hashes modulo 2 ** 64 of all stretches of a text at once, from running sums."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * BASE)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        held = max(n, 2 * len(_powers[0]), 1 << 16)
        inverse = pow(int(BASE), -1, 1 << 64)
        for k, base in enumerate((BASE, U(inverse))):
            _powers[k] = np.cumprod(np.concatenate([[U(1)], np.full(held - 1, base, U)]), dtype=U)
    return _powers[0][:n], _powers[1][:n]


def stretches(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of raw[begin:end] for each pair of bounds; equal bytes have equal hashes, wherever they stand."""
    up, down = powers(len(raw) + 1)
    total = np.concatenate([[U(0)], np.cumsum(BYTE[raw] * up[: len(raw)], dtype=U)])
    return mix((total[end] - total[begin]) * down[begin] + mix((end - begin).astype(U)))
