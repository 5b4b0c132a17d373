"""Tokenization by distinct chunks: every distinct chunk is segmented once, and texts take its ids by position.

The table of chunks belongs to one Python worker and lives as long as it does; it is
emptied when it holds ``MOST`` chunks, which costs time and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

MOST = 300_000


class _Codes(dict):
    """Chunk -> row of the table; an unknown chunk gets the next row and waits to be segmented."""

    def __init__(self):
        self.waiting = []

    def __missing__(self, chunk):
        code = self[chunk] = len(self)
        self.waiting.append(chunk)
        return code


def flat(ids: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each chunk has, and all of them in a row."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))


class ChunkTable:
    """Ids of texts that are given as lists of chunks. ``segment`` tells the ids of distinct chunks as ``flat`` does."""

    def __init__(self, segment: Callable[[list], tuple[np.ndarray, np.ndarray]]):
        self._segment = segment
        self._clear()

    def _clear(self):
        self._codes, self._used, self._known = _Codes(), 0, 0
        self._pool = np.zeros(1 << 16, np.uint32)
        self._start, self._size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self):
        chunks, self._codes.waiting = self._codes.waiting, []
        if not chunks:
            return
        sizes, ids = self._segment(chunks)
        known, used = self._known + len(sizes), self._used + len(ids)
        while known > len(self._size):
            self._start, self._size = np.concatenate([self._start] * 2), np.concatenate([self._size] * 2)
        while used > len(self._pool):
            self._pool = np.concatenate([self._pool] * 2)
        self._start[self._known : known] = self._used + np.cumsum(sizes) - sizes
        self._size[self._known : known] = sizes
        self._pool[self._used : used] = ids
        self._known, self._used = known, used

    def ids(self, texts: Sequence[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and where each text begins (n + 1)."""
        if len(self._codes) > MOST:
            self._clear()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.fromiter(map(self._codes.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        self._learn()
        per = self._size[codes]
        first = np.concatenate([[0], np.cumsum(per)])
        at = np.arange(first[-1]) + np.repeat(self._start[codes] - first[:-1], per)
        return self._pool[at], first[np.concatenate([[0], np.cumsum(sizes)])]
