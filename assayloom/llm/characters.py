"""Texts as arrays: word and window hashes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # any odd numbers; odd ones have an inverse modulo 2 ** 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a bijection on 64 bits)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of any stretches of an array of code points: equal stretches have equal hashes wherever they stand."""

    def __init__(self, codes: np.ndarray, base: np.uint64 = BASE):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, length: int) -> np.ndarray:
        """The hash of the window of this length at each position where one fits."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def word_signs() -> np.ndarray:
    """Whether a code point is a letter or digit of any alphabet."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def chunks(texts: list[str], most: int = 500_000):
    """Slices of a list of texts of about `most` characters; a longer text is a slice of its own. No text is cut."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield at, i
            at, n = i, 0
        n += len(t)
    if at < len(texts):
        yield at, len(texts)
