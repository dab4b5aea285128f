"""The seeded stream of numbers that shape searches draw from (xoshiro256**, seeded by SplitMix64)."""

from __future__ import annotations

from math import log, sqrt

_MASK = (1 << 64) - 1


def _turned(x: int, k: int) -> int:
    return (x << k | x >> 64 - k) & _MASK


class Stream:
    """One stream; equal seeds give equal numbers on every machine."""

    def __init__(self, seed: int):
        self.state, z = [], seed & _MASK
        for _ in range(4):
            z = z + 0x9E3779B97F4A7C15 & _MASK
            m = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _MASK
            m = (m ^ m >> 27) * 0x94D049BB133111EB & _MASK
            self.state.append(m ^ m >> 31)
        self.spare: float | None = None

    def whole(self) -> int:
        """64 random bits."""
        a, b, c, d = self.state
        out = _turned(b * 5 & _MASK, 7) * 9 & _MASK
        c, d = c ^ a, d ^ b
        self.state = [a ^ d, b ^ c, c ^ (b << 17 & _MASK), _turned(d, 45)]
        return out

    def unit(self) -> float:
        """A number in [0, 1) of 53 bits."""
        return (self.whole() >> 11) / (1 << 53)

    def below(self, n: int) -> int:
        """A whole number below ``n``."""
        return self.whole() % n

    def normal(self) -> float:
        """A standard normal number by the polar method, whose second number is kept for the next call."""
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            x, y = 2 * self.unit() - 1, 2 * self.unit() - 1
            s = x * x + y * y
            if 0 < s < 1:
                k = sqrt(-2 * log(s) / s)
                self.spare = y * k
                return x * k

    def step(self, spread: float) -> int:
        """A normal step as a whole number, at least one either way."""
        x = self.normal() * spread
        return round(x) or (1 if x >= 0 else -1)
