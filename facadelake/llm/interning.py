"""Words to rows of ids: what a Python worker has worked out once, kept from task to task within a bound."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable

import numpy as np


class _Known(dict):
    """Place of every word; a new word gets the next place and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[Hashable] = []

    def __missing__(self, word: Hashable) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Interner:
    """Ids of words by ``find``, which gets a list of new words and gives their lists of ids.

    Up to ``most`` words stay known; when that many are, further ones are worked out and forgotten after each call.
    """

    def __init__(self, find: Callable[[list], Iterable[list[int]]], most: int):
        self.find, self.most = find, most
        self.known = _Known()
        self.n_words = self.n_ids = 0
        self.starts, self.ids = np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def _add(self, found: Iterable[list[int]]) -> None:
        flat: list[int] = []
        ends: list[int] = []
        for ids in found:
            flat += ids
            ends.append(self.n_ids + len(flat))
        while self.n_words + len(ends) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.starts[self.n_words + 1 : self.n_words + 1 + len(ends)] = ends
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_words += len(ends)
        self.n_ids += len(flat)

    def rows(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in order, and where each word's begin (one more entry than words)."""
        known = self.known
        had, had_ids = self.n_words, self.n_ids
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.new:
            self._add(self.find(known.new))
        first = self.starts[at]
        size = self.starts[at + 1] - first
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        if self.n_words > self.most:
            for word in known.new:
                del known[word]
            self.n_words, self.n_ids = had, had_ids
        known.new = []
        return out, total
