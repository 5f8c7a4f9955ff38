"""Hashes of all substrings of one length, in numpy."""

from __future__ import annotations

import numpy as np

# Odd multipliers with well spread bits.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = [np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hashes(codes: np.ndarray, span: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of ``codes[i : i + span]`` for every i, put together from hashes of the powers of two in ``span``."""
    n = len(codes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = mixed(codes.astype(np.uint64) + np.uint64(seed))
    out, done, width, step = None, 0, 1, 0
    while True:
        if span & width:
            part = power[done : done + n]
            out = part.copy() if out is None else mixed(out * _STEPS[step % 5] + part)
            done += width
        if 2 * width > span:
            return out
        longer = power[:-width] * _STEPS[step % 5]
        longer += power[width:]
        power = mixed(longer)
        width, step = 2 * width, step + 1


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
