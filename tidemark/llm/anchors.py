"""Content-defined anchors: winnowing over byte or word sequences.

Of every window of ``window`` units the smallest k-gram hash is selected. Equal windows select
equal k-grams wherever they stand, so two places that share a whole window share an anchor. About
2 / (window - k + 2) of the positions are selected.
"""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B1  # odd, from the golden ratio


def _mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer of 32-bit hashes (multiply and xor-shift)."""
    out = values ^ (values >> np.uint32(16))
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Mixed 32-bit hash, never 0 (see select), of every k consecutive uint32 values, by doubling."""
    total, done, power = None, 0, 1
    block, size = values, 1
    mod = 1 << 32
    while True:
        if k & size:
            if total is None:
                total, done = block, size
            else:  # total covers the first `done` values, block the next `size`
                n = len(values) - done - size + 1
                scale = pow(_MULTIPLIER, size, mod)
                total = total[:n] * np.uint32(scale) + block[done : done + n]
                done += size
        if size * 2 > k:
            break
        power = pow(_MULTIPLIER, size, mod)
        block = block[:-size] * np.uint32(power) + block[size:]
        size *= 2
    return np.maximum(_mixed(total), np.uint32(1))


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def select(hashes: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each window of ``width`` hashes, and the positions that are one of them.

    ``valid`` marks window starts that count; others select nothing.
    """
    least = sliding(hashes, width, np.minimum)
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=hashes.dtype)
    np.multiply(least, valid, out=padded[width - 1 : width - 1 + len(least)])
    most = sliding(padded, width, np.maximum)
    return least, np.flatnonzero((most == hashes) & (most > 0))


def byte_values() -> np.ndarray:
    """A fixed pseudo-random uint32 for each byte value."""
    return _mixed(np.arange(1, 257, dtype=np.uint32) * np.uint32(_MULTIPLIER))
