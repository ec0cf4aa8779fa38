"""FM-index over one shard of a corpus of numbered words, and backward search of many phrases at once.

The text of a shard is a sequence of positive word numbers in which 0 ends each passage.  The index has the
Burrows-Wheeler transform in a wavelet matrix (rank of any word up to any place in as many steps as a word number has
bits) and every ``SAMPLE``-th suffix position.  Phrases of one length are searched together, one step for each word
from the last to the first.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of the text a suffix position is kept; others are found by walking to the next of these.
SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in their order, a shorter suffix before its extensions.

    Prefix doubling; a suffix that is alone in its group has its place, and only the others are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    places, key, width = np.arange(n), text[order], 1
    while len(places):
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        rank[order[places]] = places[new][group]  # a group's rank is the place where it begins
        places = places[(np.bincount(group) > 1)[group]]
        at = order[places]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[places], key = at[by], key[by]
        width *= 2
    return order


class WaveletMatrix:
    """Rank queries over a sequence of non-negative numbers, for many queries at a time."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, before, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, value: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each ``value`` occurs before the place ``end``."""
        low, high = np.zeros_like(end), end.copy()
        for bit, before, zeros in self.levels:
            one = (value >> bit & 1).astype(bool)
            low = np.where(one, zeros + before[low], low - before[low])
            high = np.where(one, zeros + before[high], high - before[high])
        return high - low

    def access(self, place: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        value = np.zeros_like(place)
        for bit, before, zeros in self.levels:
            one = (before[place + 1] - before[place]).astype(np.int64)
            value |= one << bit
            place = np.where(one == 1, zeros + before[place], place - before[place])
        return value


class FMIndex:
    """Index of a shard's text; see the module."""

    def __init__(self, text: np.ndarray) -> None:
        text = np.concatenate([text + 1, [0]]).astype(np.int64)  # a unique smallest end
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1])
        counts = np.bincount(text)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.n = len(text)
        self.sampled = order % SAMPLE == 0
        self.sample_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of word numbers the interval of the suffixes that begin with it."""
        phrases = phrases + 1
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        known = (phrases < len(self.first) - 1).all(axis=1)
        high[~known] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            word = phrases[live, column]
            low[live] = self.first[word] + self.bwt.rank(word, low[live])
            high[live] = self.first[word] + self.bwt.rank(word, high[live])
        return low, np.maximum(low, high)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these places of the order."""
        position, at = np.full(len(places), -1, dtype=np.int64), places.copy()
        open_, walked = np.arange(len(places)), 0
        while len(open_):
            here = at[open_]
            hit = self.sampled[here]
            position[open_[hit]] = self.samples[self.sample_before[here[hit]]] + walked
            open_ = open_[~hit]
            here = here[~hit]
            word = self.bwt.access(here)
            at[open_] = self.first[word] + self.bwt.rank(word, here)
            walked += 1
        return position
