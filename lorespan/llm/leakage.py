"""Held-out passages that stand in a training corpus (problem 7)."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm.fm_index import FMIndex

#: Runs of letters and digits; ``\w`` of Python is letters, digits and the underscore.
WORD = re.compile(r"[^\W_]+")

#: Test items held by a task at a time; more are searched one part after another in the same index.
ITEMS_PER_PART = 20_000

#: A shard of the index has about this many words.
SHARD_WORDS = 1_000_000


def words_of(text: str | None) -> list[str]:
    """The maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


class Shard:
    """Whole texts of the corpus as one sequence of word numbers, each text ended by a 0, to be indexed once."""

    def __init__(self) -> None:
        self.number: dict[str, int] = defaultdict(count(1).__next__)
        self.docs: list[int] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, text: str | None) -> None:
        words = words_of(text)
        numbers = np.zeros(len(words) + 1, dtype=np.int64)
        numbers[:-1] = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.docs.append(doc)
        self.texts.append(numbers)
        self.size += len(numbers)

    def phrases(self, items: list[tuple[int, list[str]]], window: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of phrases the rows of word numbers, and the item of each: every ``window`` consecutive words of an
        item, or all words of a shorter one.  Phrases with a word that the shard doesn't have are left out."""
        by_size: dict[int, list] = defaultdict(list)
        for item, words in items:
            if len(words) >= shortest:
                by_size[min(window, len(words))].append((item, words))
        for size, own in by_size.items():
            numbers = np.array([self.number[w] if w in self.number else 0 for _, words in own for w in words], dtype=np.int64)
            length = np.array([len(words) for _, words in own])
            item = np.repeat(np.array([i for i, _ in own], dtype=np.int64), length)
            left = np.repeat(np.cumsum(length), length) - np.arange(len(numbers))  # words of the item from here on
            rows = np.lib.stride_tricks.sliding_window_view(numbers, size)
            keep = (left[: len(rows)] >= size) & (rows > 0).all(axis=1)
            yield rows[keep], item[: len(rows)][keep]

    def spans(self, parts: list, window: int, shortest: int) -> pa.RecordBatch:
        """``doc``, ``item``, ``first_word``, ``last_word`` of the passages of all parts of the items."""
        text = np.concatenate(self.texts)
        length = np.array([len(t) for t in self.texts])
        doc = np.repeat(np.arange(len(length)), length)
        starts = np.cumsum(length) - length
        index = FMIndex(text)
        out = [np.zeros((0, 4), dtype=np.int64)]
        for part in parts:
            for rows, item in self.phrases(part.value, window, shortest):
                low, high = index.search(rows)
                hit = np.flatnonzero(high > low)
                times = high[hit] - low[hit]
                places = np.repeat(low[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
                at, item = index.locate(places), np.repeat(item[hit], times)
                of = doc[at]
                # Occurrences of one item, all of one length: those that overlap or touch are one passage.
                found = np.unique(np.stack([of, item, at - starts[of]], axis=1), axis=0)
                if len(found):
                    last = found[:, 2] + rows.shape[1] - 1
                    new = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] > last[:-1] + 1)])
                    first = np.flatnonzero(new)
                    ends = np.append(first[1:], len(found)) - 1
                    out.append(np.column_stack([np.array(self.docs, dtype=np.int64)[found[first, 0]], found[first, 1:], last[ends]]))
        columns = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns.T], names=["doc", "item", "first_word", "last_word"])


def leaked_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 12, shortest: int = 8) -> DataFrame:
    """Every leaked passage: ``id_col``, ``item_col``, ``first_word``, ``last_word`` (word positions in the document, from 0).

    A passage is a run of words of a document in which each ``window`` consecutive words stand in the item too, or all words of
    an item that has ``shortest`` to ``window - 1`` words.  Overlapping occurrences of one item are merged to one span.

    Method: each task indexes the whole texts of the shards of the corpus it reads with an FM-index
    (:mod:`lorespan.llm.fm_index`), once; searches all phrases of the items backwards through the ranks of a wavelet
    matrix, locates the occurrences by sampled suffix positions and merges their spans.  Texts are not shuffled.  Items are
    the stated query set: they go to the tasks in parts of at most ``ITEMS_PER_PART``, which a task searches one after
    another, so the corpus is read and indexed once, whatever their number.

    Words are maximal runs of letters and digits of the lower-cased text.  Null, empty and blank texts on either side match
    nothing, items of fewer than ``shortest`` words neither.  Items repeated word for word leak each.  A repeated document row
    counts once.  Other columns are not read.
    """
    spark = docs.sparkSession
    kept = items.select(items[item_col].cast("long").alias("item"), items[item_text].cast("string").alias("text")).where("item is not null and text is not null").distinct()
    wanted = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    number = max(1, -(-kept.count() // ITEMS_PER_PART))
    parts = []
    for part in range(number):
        rows = kept.where(F.pmod(F.xxhash64("item", "text"), F.lit(number)) == part).collect()
        parts.append(spark.sparkContext.broadcast(sorted((r["item"], words_of(r["text"])) for r in rows)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is not None and text:
                    shard.add(doc, text)
                    if shard.size >= SHARD_WORDS:
                        yield shard.spans(parts, window, shortest)
                        shard = Shard()
        if shard.size:
            yield shard.spans(parts, window, shortest)

    found = wanted.mapInArrow(search, "doc long, item long, first_word long, last_word long")
    return found.distinct().toDF(id_col, item_col, "first_word", "last_word")  # for rows delivered twice


def leaked_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Each document with each item that leaked into it: ``doc_id``, ``item_id``; see :func:`leaked_passages`."""
    spans = leaked_passages(docs, items, **options)
    return spans.select(*spans.columns[:2]).distinct()
