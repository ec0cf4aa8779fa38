"""Records that are alike up to small edits, by T-occurrence search with DivideSkip (problem 2)."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.session import numbered, written

#: A block of more sets is split by the next rare word that its sets share.
HOT_RECORDS = 4_000

#: Rare words in a block's key at most.  Blocks that are still larger are cut to parts of ``HOT_RECORDS`` sets, which are compared
#: part by part.
MOST_WORDS = 3

#: Inverted lists up to this length are merged, longer ones are probed (as far as the required overlap allows).
SHORT_LIST = 8

#: Entries of inverted lists that are merged at a time, and rows of blocks that are searched at a time.
STEP, ROWS = 2_000_000, 50_000


def word_set(*columns: Column) -> Column:
    """The distinct words, maximal runs of letters and digits of the lower-cased text, of strings and arrays of strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))))


def least_overlap(size, threshold: float):
    """Fewest words that a set of ``size`` shares with any set whose Jaccard similarity to it is at least ``threshold``."""
    return np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)


def pair_overlap(sizes, threshold: float):
    """Fewest words shared by two sets of these sizes together whose similarity is at least ``threshold``."""
    return np.maximum(1, np.ceil(threshold / (1 + threshold) * sizes - 1e-9)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` on, ``count`` of them."""
    return np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)


def _member(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` stand in the sorted ``keys``, by binary search."""
    at = np.searchsorted(keys, wanted)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class Blocks:
    """Some whole blocks of sets, and the T-occurrence search for the similar pairs in each of them.

    A row is a set in a block: ``block`` (its number, rows of a block following each other), ``size`` of the set, ``words`` with
    ``start`` (offsets), numbers of words in ascending order, the rarest first, and ``at``, the place of the block's last
    word.  The block's words are the first ``depth`` words that its pairs share; so a pair is found in one block
    only.  ``exact``: pairs of the block that share more words are found in others.  ``side`` tells apart the parts of blocks cut in two.
    """

    def __init__(self, block: np.ndarray, size: np.ndarray, at: np.ndarray, start: np.ndarray, words: np.ndarray, depth: np.ndarray, exact: np.ndarray, side: np.ndarray, tie: np.ndarray, threshold: float) -> None:
        order = np.lexsort((tie, size, block))  # the smaller sets of a block first: each set is a query to those before it
        self.order, self.threshold = order, threshold
        self.block, self.size, self.depth, self.exact, self.side = block[order], size[order].astype(np.int64), depth[order].astype(np.int64), exact[order], side[order]
        n = len(order)
        length = np.diff(start)[order]
        flat = words[_ranges(start[:-1][order], length)]
        row = np.repeat(np.arange(n), length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        _, flat = np.unique(flat, return_inverse=True)
        self.width = int(flat.max(initial=0)) + 1
        self.sets = row * self.width + flat  # ascending, as the words of a row are
        after = place > at[order][row]
        before = place < at[order][row]
        self.early = row[before], flat[before]
        # Inverted lists of the words behind the block's: entries sorted by block, word and row.
        row, flat = row[after], flat[after]
        key = self.block[row] * self.width + flat
        by = np.argsort(key, kind="stable")
        self.row, key = row[by], key[by]
        self.list_starts = _starts(key)
        self.list = np.repeat(np.arange(len(self.list_starts)), np.diff(np.append(self.list_starts, len(key))))
        self.postings = self.list * n + self.row  # ascending: what is probed
        self.n = n

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``a`` and ``b`` (numbers as given) and the similarity of each similar pair."""
        n, t = self.n, self.threshold
        need = least_overlap(self.size, t)
        left = need - self.depth  # the least overlap behind the block's words
        # Smaller sets that are too small for a query are a first part of its block.
        top = int(self.size.max(initial=0)) + 1
        sized = self.block * top + self.size
        first = np.searchsorted(sized, self.block * top + need)
        # Each entry is a query's inverted list: the rows from ``first`` on that come before it.
        low = np.searchsorted(self.postings, self.list * n + first[self.row])
        count = np.maximum(0, np.arange(len(self.row)) - low)
        use = np.flatnonzero(count)
        # DivideSkip: of each query's lists the longest are left out of the merge, as many as the overlap allows.
        use = use[np.lexsort((-count[use], self.row[use]))]
        row = self.row[use]
        begins = _starts(row)
        rank = np.arange(len(row)) - np.repeat(begins, np.diff(np.append(begins, len(row))))
        long_ = (rank < left[row] - 1) & (count[use] > SHORT_LIST)
        probed = np.bincount(row[long_], minlength=n)
        short = use[~long_]
        probe = np.full((n, int(probed.max(initial=0))), -1, dtype=np.int64)
        probe[row[long_], rank[long_]] = self.list[use[long_]]

        out, merged_few = [], [np.zeros(0, np.int64)]
        emitted = np.cumsum(count[short])
        starts = _starts(self.row[short])
        ends = np.append(starts[1:], len(short))
        done = 0
        while done < len(starts):
            reached = emitted[starts[done] - 1] if starts[done] else 0
            stop = max(done + 1, int(np.searchsorted(emitted[ends - 1], reached + STEP, side="right")))
            part = short[starts[done] : ends[stop - 1]]
            done = stop
            other = self.row[_ranges(low[part], count[part])]
            merged = np.repeat(self.row[part], count[part]) * n + other
            merged.sort(kind="stable")  # a merge of the sorted lists
            runs = _starts(merged)
            total = np.diff(np.append(runs, len(merged)))
            out.append(self._verified(merged[runs], total, left, probed, probe))
            merged_few.append(merged[runs][left[merged[runs] // n] <= 0])
        # Sets so small that sharing the block's words alone is enough.
        few = np.flatnonzero(left <= 0)
        if len(few):
            most = np.floor(self.depth[few] * (1 + t) / t + 1e-9).astype(np.int64) - self.size[few]
            end = np.minimum(few, np.searchsorted(sized, self.block[few] * top + np.minimum(most, top - 1), side="right"))
            number = np.maximum(0, end - first[few])
            key = np.repeat(few, number) * n + _ranges(first[few], number)
            key = key[~np.isin(key, np.concatenate(merged_few))]
            out.append(self._verified(key, np.zeros(len(key), np.int64), left, probed * 0, probe[:, :0]))
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return self.order[a], self.order[b], s

    def _verified(self, key: np.ndarray, total: np.ndarray, left: np.ndarray, probed: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The similar pairs of candidates: the lists left out are probed one after another, as long as a pair can still have enough."""
        a, b = key // self.n, key % self.n
        keep = (total >= left[a] - probed[a]) & ((self.side[a] != self.side[b]) | (self.side[a] < 0))
        a, b, total = a[keep], b[keep], total[keep]
        required = pair_overlap(self.size[a] + self.size[b], self.threshold) - self.depth[a]
        for k in range(probe.shape[1] + 1):
            keep = total + np.maximum(0, probed[a] - k) >= required
            a, b, total, required = a[keep], b[keep], total[keep], required[keep]
            if k < probe.shape[1]:
                own = probe[a, k]
                total = total + ((own >= 0) & _member(self.postings, own * self.n + b))
        common = total + self.depth[a]
        union = self.size[a] + self.size[b] - common
        keep = (common >= self.threshold * union - 1e-9) & (~self.exact[a] | (total == 0))
        a, b, common, union = a[keep], b[keep], common[keep], union[keep]
        # Pairs that share an earlier word are found in that word's block.
        row, word = self.early
        low, high = np.searchsorted(row, a), np.searchsorted(row, a, side="right")
        pair = np.repeat(np.arange(len(a)), high - low)
        shared = _member(self.sets, b[pair] * self.width + word[_ranges(low, high - low)])
        earlier = np.bincount(pair[shared], minlength=len(a))
        keep = earlier == self.depth[a] - 1  # the block's own words before the last
        return a[keep], b[keep], common[keep] / union[keep]


def _posted(sets: DataFrame, threshold: float) -> DataFrame:
    """The sets in the blocks of their rare words: ``w1``, ``w2``, ``w3`` (0 for none), ``at``, ``exact``, ``low``, ``high``, ``side`` and the set.

    Two similar sets share one of the few rarest words of each (its size less the required overlap, and one); so a word's block
    are the sets that have it among these.  Sets of a large block go on to those of the word and a second one that they
    share, for which one more word of each comes into question, and so on.
    """
    need = F.greatest(F.ceil(F.lit(threshold) * F.col("size") - 1e-9), F.lit(1)).cast("int")
    gone = F.col("size") - F.size("words")  # words of no other set
    key = [f"w{i}" for i in range(1, MOST_WORDS + 1)]

    def rare(last: Column, depth: int) -> Column:
        """The words behind ``last`` that can be the pair's next shared one, with their places."""
        end = F.col("size") - F.greatest(need, F.lit(depth)) + (depth - 1) - gone  # the last place, from 0
        from_ = last + 1
        return F.when(end >= from_, F.transform(F.sequence(from_, end), lambda i: F.struct(i.cast("int").alias("at"), F.get("words", i.cast("int")).alias("w"))))

    base = ["id", "size", "words"]
    first = sets.select(*base, F.explode(rare(F.lit(-1), 1)).alias("r")).select(*base, F.col("r.w").alias("w1"), *(F.lit(0).cast(sets.schema["words"].dataType.elementType).alias(k) for k in key[1:]), "r.at", F.lit(False).alias("exact"))
    done, open_ = None, first
    for depth in range(1, MOST_WORDS + 1):
        own = key[:depth]
        hot = written(open_.groupBy(*own).count().where(F.col("count") > HOT_RECORDS), "hot")
        if hot.isEmpty():
            break
        small = open_.join(hot, own, "left_anti")
        done = small if done is None else done.unionByName(small)
        open_ = open_.join(hot, own)
        if depth == MOST_WORDS:
            parts = F.ceil(F.col("count") / F.lit(HOT_RECORDS)).cast("int")
            part = F.pmod(F.xxhash64("id"), parts).cast("int")
            cut = open_.withColumn("side", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            cut = cut.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
            plain = done.withColumns({"low": F.lit(-1), "high": F.lit(-1), "side": F.lit(-1)})
            return plain.unionByName(cut.withColumn("side", F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("side"))).select(plain.columns))
        # Sets that may share these words alone stay, for the pairs that do.
        done = done.unionByName(open_.where(need <= depth).drop("count").withColumn("exact", F.lit(True)))
        next_ = open_.select(*base, *own, F.explode(rare(F.col("at"), depth + 1)).alias("r"))
        open_ = next_.select(*base, *own, F.col("r.w").alias(key[depth]), *(F.lit(0).cast(sets.schema["words"].dataType.elementType).alias(k) for k in key[depth + 1 :]), "r.at", F.lit(False).alias("exact"))
    whole = open_ if done is None else done.unionByName(open_.select(done.columns))
    return whole.withColumns({"low": F.lit(-1), "high": F.lit(-1), "side": F.lit(-1)})


def ranked_sets(sets: DataFrame) -> DataFrame:
    """``id``, ``size`` and ``words``, the numbers of the set's words in ascending order.

    ``sets`` has ``id`` (long) and ``words``, an array of distinct words that are not null; repeated rows count once.  Words are
    numbered by their number of sets, so that numbers ascend with frequency.  Words of one set only have none: they
    can't be shared, and count in the size alone.
    """
    exploded = sets.select("id", F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = exploded.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    words, total = numbered(counts, "n", "word")
    kind = "int" if total < 2**31 else "long"
    coded = exploded.join(words.select("word", F.col("number").cast(kind).alias("number")), "word", "left")
    return written(coded.groupBy("id", "size").agg(F.array_sort(F.collect_set("number")).alias("words")), "ranked")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """``a``, ``b`` (``a < b``), ``similarity``: pairs of different sets of at least this Jaccard similarity.

    ``sets`` is the result of :func:`ranked_sets`, with unique ids.  They are shuffled to the blocks of their rare words
    (:func:`_posted`), and each block is searched by :class:`Blocks`: of a set's inverted lists the short ones are merged,
    and the sets that stand in enough of them are looked up in the long ones by binary search, until they have the
    required overlap or can't.
    """
    key = [f"w{i}" for i in range(1, MOST_WORDS + 1)] + ["low", "high"]
    posts = _posted(sets, threshold).select(*key, "id", "size", "words", "at", "exact", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def found(table: pa.Table) -> pa.RecordBatch:
            columns = {c: table[c].combine_chunks() for c in table.column_names}
            keys = [columns[k].to_numpy() for k in key]
            starts = _starts(*keys)
            block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
            depth = sum((columns[k].to_numpy() != 0).astype(np.int64) for k in key[:MOST_WORDS])
            offsets = columns["words"].offsets.to_numpy().astype(np.int64)
            ids = columns["id"].to_numpy()
            one = Blocks(
                block, columns["size"].to_numpy(), columns["at"].to_numpy(), offsets - offsets[0], columns["words"].flatten().to_numpy(), depth,
                columns["exact"].to_numpy(zero_copy_only=False), columns["side"].to_numpy(), ids, threshold,
            )
            a, b, s = one.pairs()
            a, b = ids[a], ids[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], names=["a", "b", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if size + batch.num_rows > ROWS and held:
                # Search the blocks that end before this batch; the last one may go on.
                table = pa.Table.from_batches([*held, batch])
                last = _starts(*(table[k].to_numpy() for k in key))[-1]
                if last:
                    yield found(table.slice(0, last))
                held, size = table.slice(last).to_batches(), table.num_rows - last
            else:
                held.append(batch)
                size += batch.num_rows
        if size:
            yield found(pa.Table.from_batches(held))

    blocks = posts.repartition(*key).sortWithinPartitions(*key)
    return blocks.mapInArrow(search, "a long, b long, similarity double")


def similar_records(records: DataFrame, threshold: float = 0.7, fewest: int = 10, id_col: str = "summary_id", text_cols: tuple[str, ...] = ("title", "description", "tags")) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal sets of words, and the pairs of similar classes.

    Returns ``members`` (``id``, ``class``: the smallest id with the same words) and ``pairs`` (``a``, ``b``, ``similarity``
    of classes, ``a < b``), so that copies are not expanded to pairs.  A record's set is the distinct words of its text
    columns, strings or arrays; records with fewer than ``fewest`` words, among them all whose columns are null or
    empty, are left out.  Ids are unique but for repeated rows, which count once; null ids don't count; an empty table gives no rows.
    """
    rows = records.select(records[id_col].cast("long").alias("id"), word_set(*(records[c] for c in text_cols)).alias("words"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("words") >= fewest))
    ranked = ranked_sets(rows)
    # A set with a word of its own is no copy; others are copies if size and words agree, told by a hash of 128 bits.
    alone = F.when(F.size("words") < F.col("size"), F.col("id"))
    hashes = [F.xxhash64("size", "words", alone, F.lit(i)).alias(f"h{i}") for i in (1, 2)]
    keyed = ranked.select("id", *hashes)
    members = written(keyed.join(keyed.groupBy("h1", "h2").agg(F.min("id").alias("class")), ["h1", "h2"]).select("id", "class"), "members")
    copies = members.where(F.col("id") != F.col("class")).select("id")
    return members, similar_sets(ranked.join(copies, "id", "left_anti"), threshold)


def found_pairs(records: DataFrame, threshold: float = 0.7, fewest: int = 10) -> DataFrame:
    """``summary_a < summary_b``: all pairs of records whose similarity is at least ``threshold``; see :func:`similar_records`."""
    members, pairs = similar_records(records, threshold, fewest)
    one, other = members.toDF("x", "a"), members.toDF("y", "b")
    between = pairs.join(one, "a").join(other, "b")
    within = one.join(other.withColumnRenamed("b", "a"), "a").where("x < y")
    ends = between.select("x", "y").unionByName(within.select("x", "y"))
    return ends.select(F.least("x", "y").alias("summary_a"), F.greatest("x", "y").alias("summary_b")).distinct()
