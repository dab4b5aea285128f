"""Vectorised word hashes of UTF-8 texts (numpy, inside tasks).

A word's hash is a polynomial over its bytes, taken from one running sum over many
texts, so that no Python loop runs over words.  Bytes pass through a table of random
64-bit values first, and the result through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are hashed in blocks of about this many bytes.
BLOCK = 1 << 20

#: A-Z become a-z, every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of the words ``[^\x20\x09-\x0D]+``.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            table = np.multiply.accumulate(steps)
            if size > 8 * BLOCK:  # one huge text: don't hold on to its table
                _powers.setdefault(name, table[: 2 * BLOCK].copy())
                _powers[name + "_big"] = table
            else:
                _powers[name] = table
        if size > 8 * BLOCK:
            return _powers.pop("up_big"), _powers.pop("down_big")
    return _powers["up"], _powers["down"]


def running(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, down) of bytes: those from a to b hash to ``(total[b] - total[a]) * down[a]``."""
    up, down = _power_table(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return total, down


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(raw: np.ndarray, separators: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in lower-cased bytes that begin and end with a separator.

    With ``prefix`` only a word's first bytes are hashed.
    """
    sep = separators[raw]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    total, down = running(raw)
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space (a longer word stays whole)."""
    at = 0
    while len(data) - at > 2 * BLOCK:
        cut = data.rfind(b" ", at, at + BLOCK)
        if cut <= at:
            cut = data.find(b" ", at + BLOCK)
            if cut < 0:
                break
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(texts: list[str | None], separators: np.ndarray = WHITE, prefix: int = 0) -> Iterator[np.ndarray]:
    """For each text the uint64 hashes of its lower-cased words in order; none for null."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        raw = LOWER[np.frombuffer(b" " + b" ".join(group) + b" ", dtype=np.uint8)]
        hashes, starts = _words(raw, separators, prefix)
        bounds = np.cumsum([1] + [len(g) + 1 for g in group])
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield hashes[a:b]

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > 2 * BLOCK:
            yield from flush()
            group, size = [], 0
            parts = []
            for piece in _pieces(data):
                raw = LOWER[np.frombuffer(b" " + piece + b" ", dtype=np.uint8)]
                parts.append(_words(raw, separators, prefix)[0])
            yield np.concatenate(parts)
            continue
        group.append(data)
        size += len(data)
        if size >= BLOCK:
            yield from flush()
            group, size = [], 0
    yield from flush()


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles; fewer words are one shingle, no words none."""
    n = len(words)
    if n == 0:
        return words
    take = min(n, width)
    h = np.full(n - take + 1, np.uint64(take), dtype=np.uint64)
    for j in range(take):
        h = h + words[j : n - take + 1 + j] * _SHINGLE[j]
    return mix(h)
