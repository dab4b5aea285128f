"""Burrows-Wheeler transform and common prefixes of a collection, column by column (numpy, inside tasks).

Round j inserts the j-th symbol from the end of every document of the collection.  Two
buffers are read and written once a round from start to end: the transform (the symbol
before each suffix, in the order of the suffixes) and the common prefix of each suffix with
the one before it.  The suffix that a new symbol makes of a known one stands where the
symbol's rank among equal symbols puts it; its common prefix is one more than the least
between the two known suffixes that it and its neighbour extend.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Collection:
    """Sorted suffixes of documents: ``symbols`` before them, ``common`` prefixes with the one before.

    The first rows are the documents' empty suffixes, in their order.
    """

    symbols: np.ndarray
    common: np.ndarray
    lengths: np.ndarray

    def rows(self):
        """(length, documents, rows): where the suffixes of each length stand, the shortest first, by walking the transform."""
        order = np.argsort(self.symbols, kind="stable")
        none = int(np.count_nonzero(self.symbols == 0))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order)) + (len(self.lengths) - none)
        docs = np.arange(len(self.lengths))
        at = docs
        for n in range(1, int(self.lengths.max(initial=0)) + 1):
            live = self.lengths[docs] >= n
            docs, at = docs[live], place[at[live]]
            yield n, docs, at


def _columns(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols by distance from the end and document; 0 where a document has ended, others in the bytes' order."""
    used = np.zeros(256, dtype=bool)
    used[data] = True
    if used.all():
        raise ValueError("a collection must leave one byte value unused")
    code = np.cumsum(used).astype(np.uint8)
    ends = np.cumsum(lengths)
    out = np.zeros((int(lengths.max(initial=0)), len(lengths)), dtype=np.uint8)
    for j in range(len(out)):
        live = np.flatnonzero(lengths > j)
        out[j, live] = code[data[ends[live] - 1 - j]]
    return out


def build(data: np.ndarray, lengths: np.ndarray) -> Collection:
    """The collection of documents that stand one behind the other in the bytes ``data``."""
    m = len(lengths)
    columns = _columns(data, lengths)
    kind = np.uint8 if len(columns) < 255 else np.uint32
    symbols, common = np.zeros(m, dtype=np.uint8), np.zeros(m, dtype=kind)
    newest, docs = np.arange(m), np.arange(m)
    for column in columns:
        symbol = column[docs]
        symbols[newest] = symbol
        live = symbol > 0
        newest, docs = newest[live], docs[live]
        # rows in the order of symbol and suffix: the suffixes with one symbol more, after the empty ones
        order = np.argsort(symbols, kind="stable")
        none = len(symbols) - int(np.count_nonzero(symbols))
        order = order[none:]
        place = np.empty(len(symbols), dtype=np.int64)
        place[order] = np.arange(len(order))
        new = place[newest]
        by_place = np.argsort(new)
        new, docs = new[by_place], docs[by_place]
        # what is new, and what now follows it, has another neighbour before it
        changed = np.zeros(len(order) + 1, dtype=bool)
        changed[new] = changed[new + 1] = True
        changed = np.flatnonzero(changed[:-1])
        here, before = order[changed], order[changed - 1]
        alike = (changed > 0) & (symbols[here] == symbols[before])
        least = np.zeros(len(changed), dtype=kind)
        low, high = before[alike] + 1, here[alike] + 1
        back = np.argsort(-low, kind="stable")  # so that only the ranges asked for are read
        ranges = np.stack((low[back], high[back]), axis=1).reshape(-1)
        found = np.empty(len(back), dtype=kind)
        if len(back):
            found[back] = np.minimum.reduceat(np.append(common, kind(0)), ranges)[::2] + kind(1)
        least[alike] = found
        # both buffers with the new rows between the old ones
        old = np.ones(m + len(order), dtype=bool)
        old[m + new] = False
        next_symbols, next_common = np.zeros(len(old), dtype=np.uint8), np.zeros(len(old), dtype=kind)
        next_symbols[old], next_common[old] = symbols, common
        next_common[m + changed] = least
        symbols, common, newest = next_symbols, next_common, m + new
    symbols[newest] = 0
    return Collection(symbols, common, lengths)
