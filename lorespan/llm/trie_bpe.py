"""Byte-pair encoding of many distinct words at once, by a walk over their prefix trie.

For one prefix of a word the *last token* of its encoding determines the rest: what stands before the last token is
the encoding of a shorter prefix.  So the state of a trie node is a single token id, a child's state follows from its
ancestors' states, and all words that share a prefix share the work for it.  Sorted words are the trie in depth-first
order: the stack of states up to the common prefix of two neighbours stays, only the rest is computed.

A token ``t`` ends the encoding of a prefix exactly if it is a suffix of it and stays apart from the last token before
it.  Two tokens stay apart if byte-pair merging of their joined bytes never merges across the border; that is read off
their merge histories, without merging anything (``_apart``).
"""

from __future__ import annotations

import base64
from collections import defaultdict
from itertools import chain, count, islice
from typing import Iterable, Iterator

import numpy as np
import regex

#: Fixed value: the split pattern of the public vocabulary ``byte_bpe_50k``.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts are encoded in blocks of about this many characters, so that the words of a block fit in memory.
BLOCK_CHARS = 4_000_000

#: Encodings of distinct words kept by one worker; past it the memory is emptied (results don't depend on it).
CACHE_WORDS = 500_000


class TrieEncoder:
    """Encoder for a vocabulary file of lines ``base64(token bytes) rank``."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(SPLIT_PATTERN)
        self.bytes_of = {r: token for token, r in self.rank.items()}
        self.width = {r: len(token) for token, r in self.rank.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, r in self.rank.items():
            if len(token) > 1 and (pair := self._last_merge(token, r)):
                self.parts[r] = pair
                self.joined[pair] = r
        self.apart_memo: dict[int, bool] = {}
        self._forget()
        self._suffix_automaton()

    def _last_merge(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``: merge its bytes by rank, but never up to its own rank."""
        cuts = [i for i in range(1, len(token)) if self.rank.get(token[:i], limit) < limit and self.rank.get(token[i:], limit) < limit]
        if len(cuts) == 1:
            return self.rank[token[: cuts[0]]], self.rank[token[cuts[0] :]]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, limit) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= limit:
                return None
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _apart(self, a: int, b: int) -> bool:
        """Whether the encodings ``[a]`` and ``[b]`` put side by side are the encoding of their joined bytes.

        Walks back through both merge histories from the youngest merge on.  ``a``'s rightmost and ``b``'s leftmost
        part of an age touch at the border; if these two could merge before either took part in the next merge of its
        own history, the border would vanish.  Of equally ranked merges the left one comes first.
        """
        key = a << 24 | b
        joined, parts = self.joined, self.parts
        bound = 1 << 40
        while True:
            merged = joined.get((a, b))
            if merged is not None and merged < bound:
                result = False
                break
            left, right = parts.get(a), parts.get(b)
            if left is None and right is None:
                result = True
                break
            if right is None or (left is not None and a > b):
                bound = a
                a = left[1]
            else:
                bound = b + 1
                b = right[0]
        if len(self.apart_memo) > 2_000_000:
            self.apart_memo.clear()
        self.apart_memo[key] = result
        return result

    def _suffix_automaton(self) -> None:
        """States are the prefixes of all tokens; a state's tokens are those that end there, the longest first."""
        step: dict[int, int] = {}
        own: list[int] = [-1]
        for token, r in self.rank.items():
            state = 0
            for byte in token:
                nxt = step.get(state << 8 | byte)
                if nxt is None:
                    nxt = step[state << 8 | byte] = len(own)
                    own.append(-1)
                state = nxt
            own[state] = r
        children: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, nxt in step.items():
            children[key >> 8].append((key & 255, nxt))
        back = [0] * len(own)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        wave = [0]
        while wave:
            after = []
            for state in wave:
                for byte, nxt in children[state]:
                    if state:
                        at = back[state]
                        while at and (at << 8 | byte) not in step:
                            at = back[at]
                        back[nxt] = step.get(at << 8 | byte, 0)
                    ends[nxt] = ends[back[nxt]]
                    if own[nxt] >= 0:
                        ends[nxt] = ((own[nxt], len(self.bytes_of[own[nxt]])), *ends[nxt])
                    after.append(nxt)
            wave = after
        self.step, self.back, self.ends = step, back, ends

    def _move(self, state: int, byte: int) -> int:
        step, back, at = self.step, self.back, state
        while at and (at << 8 | byte) not in step:
            at = back[at]
        nxt = step.get(at << 8 | byte, 0)
        if len(step) < 4_000_000:
            step[state << 8 | byte] = nxt
        return nxt

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of distinct words in byte order: one depth-first pass over their trie."""
        step, ends, memo, apart, width = self.step, self.ends, self.apart_memo, self._apart, self.width
        known = memo.get
        states = [0]  # of the automaton, and the last token, of each prefix of the current word
        path = [-1]
        before = b""
        for word in words:
            n = len(word)
            shared, most = 0, min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :], states[shared + 1 :]
            state, end = states[shared], shared
            for byte in word[shared:]:
                end += 1
                try:
                    state = step[state << 8 | byte]
                except KeyError:
                    state = self._move(state, byte)
                states.append(state)
                for token, size in ends[state]:
                    last = path[end - size]
                    if last < 0:
                        break
                    fits = known(last << 24 | token)
                    if fits or (fits is None and apart(last, token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                path.append(token)
            before = word
            ids, at = [], n
            while at:
                token = path[at]
                ids.append(token)
                at -= width[token]
            ids.reverse()
            yield ids

    def word_numbers(self, words: Iterable[str]) -> np.ndarray:
        """Numbers of words; words not seen before get the next ones, and their encodings are learned."""
        numbers = np.fromiter(map(self.number.__getitem__, words), dtype=np.int32)
        if len(self.number) > len(self.starts) - 1:
            new = sorted((w.encode("utf-8", "replace"), i) for w, i in islice(reversed(self.number.items()), len(self.number) - len(self.starts) + 1))
            found: list[list[int]] = [[]] * len(new)
            first = len(self.starts) - 1
            for (_, i), ids in zip(new, self.encode_sorted([w for w, _ in new])):
                found[i - first] = ids
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), dtype=np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        return numbers

    def _forget(self) -> None:
        """Empty the memory of words."""
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[int, list[list[str]], np.ndarray]]:
        """Runs of texts as (index of the first, words of each, numbers of all their words one after another).

        The numbers hold until the next run is asked for.
        """
        at, size, block = 0, 0, []
        for i, text in enumerate(texts):
            block.append(self.split.findall(text) if text else [])
            size += len(text or "")
            if size >= BLOCK_CHARS or i == len(texts) - 1:
                if len(self.number) > CACHE_WORDS:
                    self._forget()
                yield at, block, self.word_numbers(chain.from_iterable(block))
                at, size, block = i + 1, 0, []

    def token_counts(self, numbers: np.ndarray) -> np.ndarray:
        """How many tokens each of these words has."""
        return self.starts[numbers + 1] - self.starts[numbers]

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these words one after another."""
        first, sizes = self.starts[numbers], self.token_counts(numbers)
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets (one more than texts) at which each begins."""
        values, lengths = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, block, numbers in self.blocks(texts):
            values.append(self.tokens(numbers))
            ends = np.concatenate([[0], np.cumsum(self.token_counts(numbers))])
            stops = np.cumsum([len(words) for words in block])
            lengths.append(np.diff(ends[stops], prepend=0))
        return np.concatenate(values), np.cumsum(np.concatenate(lengths))


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]
