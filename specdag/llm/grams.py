"""Hashed character n-grams of many words at once, in numpy."""

from __future__ import annotations

import numpy as np

_BEGIN, _END = 2, 3
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_grams(words: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, 64-bit hash) of every n-gram of every word with a border mark at each end, for each n of ``sizes``."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    last = np.repeat(np.cumsum(lengths), lengths)  # one past the word's end mark
    whose, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + (codes[k : len(codes) - n + 1 + k] + np.uint64(1)) * _SEEDS[k]
            inside = np.arange(len(h)) + n <= last[: len(h)]
            whose.append(owner[: len(h)][inside])
            found.append(mix(h[inside]))
    return np.concatenate(whose), np.concatenate(found)
