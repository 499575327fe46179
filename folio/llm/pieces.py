"""Ids of the pieces that texts are cut into, kept between the batches of a worker."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import islice

import numpy as np


def gather(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """source[start : start + size] of all pieces, one behind the other."""
    total = int(sizes.sum())
    if not total:
        return source[:0]
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return source[shift + np.arange(total)]


def _room(a: np.ndarray, size: int) -> np.ndarray:
    if size <= len(a):
        return a
    more = np.empty(max(size, 2 * len(a)), a.dtype)
    more[: len(a)] = a
    return more


class PieceIds:
    """Encodes texts piece by piece; a piece is encoded once while it is kept. At ``most`` pieces all are forgotten."""

    def __init__(self, cut: Callable[[str], list[str]], encode: Callable[[list[str]], list[np.ndarray]], most: int = 1_000_000) -> None:
        self.cut, self.encode_pieces, self.most = cut, encode, most
        self.known: defaultdict[str, int] = defaultdict()
        self._reset()

    def _reset(self) -> None:
        self.known.default_factory = None  # no cycle: the old pieces go at once
        self.known = defaultdict()  # pieces are numbered as they come
        self.known.default_factory = self.known.__len__
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the last one's end)."""
        if len(self.known) > self.most:
            self._reset()
        base = len(self.known)
        codes = [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in (self.cut(t) if t else [] for t in texts)]
        many = len(self.known)
        if many > base:
            try:
                made = self.encode_pieces(list(islice(reversed(self.known), many - base))[::-1])
            except BaseException:
                self._reset()  # else numbers without ids would stay
                raise
            sizes = np.array([len(m) for m in made], np.int64)
            total = int(sizes.sum())
            self.first, self.size = _room(self.first, many), _room(self.size, many)
            self.size[base:many] = sizes
            self.first[base:many] = self.used + np.cumsum(sizes) - sizes
            self.flat = _room(self.flat, self.used + total)
            self.flat[self.used : self.used + total] = np.concatenate(made)
            self.used += total
        ids, ends = [np.empty(0, np.int32)], [0]
        for code in codes:
            ids.append(gather(self.flat, self.first[code], self.size[code]))
            ends.append(ends[-1] + len(ids[-1]))
        return np.concatenate(ids), np.array(ends, np.int64)
