"""Hashes of the words of a text, computed for all its words at once.

A running polynomial over the bytes, modulo 2 ** 64 and with an odd base, gives the hash of any stretch
as a difference times a power of the base's inverse. Separators are the six of ``bytes.split``.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longer texts are hashed in pieces, cut at separators, so that the tables of powers stay small.
PIECE = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1 << 14)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _piece(data: np.ndarray) -> np.ndarray:
    gap = _SEPARATOR[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    _powers.reach(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers.up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _powers.down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each word; ``lower`` first lower-cases A-Z."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if lower:
        data = _LOWER[data]
    if len(data) <= PIECE:
        return _piece(data)
    out, start = [], 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and not _SEPARATOR[data[end]]:
            end += 1
        out.append(_piece(data[start:end]))
        start = end
    return np.concatenate(out)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each stretch of n words; none if there are fewer."""
    m = len(words) - n + 1
    acc = np.full(max(m, 0), n, np.uint64)
    for k in range(n if m > 0 else 0):
        acc = mixed(acc * np.uint64(_BASE) + words[k : m + k])
    return acc
