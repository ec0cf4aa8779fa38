"""The most similar vectors of every vector, by a permutation index (problem 1)."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.session import written

#: Rows on which the index is fitted (pivots are chosen) at least, and for each pivot.  Every row is indexed.
FIT_ROWS, FIT_FOR_PIVOT = 20_000, 4

#: Most pivots.  Below it there are two times the root of the number of vectors, so that the lists of two pivots keep their length.
MOST_PIVOTS = 16_384

#: Pivots in a vector's permutation; leading ones in whose files it is posted; leading ones of which a pair must share a second.
LENGTH, POSTED, SHARED = 10, 4, 7

#: Least footrule similarity of a candidate, as a share of that of equal permutations.
LEAST_FOOTRULE = 0.3

#: A file of more vectors is replaced by those of two of its pivots, and such a one by those of three.  What is still larger then, as
#: vectors of one dense cluster have the same pivots, is cut to parts of this size that are compared part by part.
FILE_ROWS = 4_000

#: Most files that are known by name to be large: for very many vectors ``FILE_ROWS`` grows to keep this, so the list stays small.
LARGE_FILES = 1_000_000

#: Bytes that a task should read of the files.
TASK_BYTES = 8_000_000


def usable(column, size: int):
    """Not null, of the right length, all entries finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) == size) & ~bad & F.exists(column, lambda x: x != 0)


def usable_vectors(chunks: DataFrame, size: int = 64, id_col: str = "chunk_id", vector_col: str = "embedding", version_col: str = "upserted_at") -> DataFrame:
    """``id``, ``version``, ``vector`` and a hash of 128 bits of the vector (``h1``, ``h2``) of each usable row; -0.0 equals 0.0."""
    rows = chunks.select(chunks[id_col].cast("string").alias("id"), chunks[version_col].alias("version"), chunks[vector_col].cast("array<float>").alias("vector"))
    kept = rows.where(F.col("id").isNotNull() & usable(F.col("vector"), size))
    plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0).cast("float")).otherwise(x))
    return kept.select("id", "version", plain.alias("vector")).select("*", F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2"))


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    vectors = flat.reshape(-1, size).astype(np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _permutations(unit: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, the nearest first."""
    near = -(unit.astype(np.float32) @ pivots.T)
    length = min(length, len(pivots))
    rows = np.arange(len(unit))[:, None]
    first = np.argpartition(near, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(length), (len(unit), 1))
    return first[rows, np.argsort(near[rows, first], axis=1, kind="stable")].astype(np.int32)


def footrule_similarity(perms: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """For each pair of rows of ``perms`` the sum, over shared pivots, of the smaller weight, a pivot's weight being its place
    counted from the end.  Equal permutations have ``l (l + 1) / 2``; the Spearman footrule distance, with pivots that are
    not in a permutation put right behind its end, is twice what is missing to that."""
    columns = [np.ascontiguousarray(c, dtype=np.int16) for c in perms.T]
    length = len(columns)
    total = np.zeros(len(a), dtype=np.uint8)
    for start in range(0, len(a), step):  # as much at a time as the processor's cache holds
        part = slice(start, start + step)
        one, other = [c[a[part]] for c in columns], [c[b[part]] for c in columns]
        sum_ = total[part]
        for i in range(length):
            for j in range(length):
                sum_ += (one[i] == other[j]).view(np.uint8) * np.uint8(length - max(i, j))
    return total


def _pairs_of_lists(rows: np.ndarray, starts: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same list, about ``most`` at a time; lists follow each other and begin at ``starts``."""
    ends = np.append(starts[1:], len(rows))
    after = np.repeat(ends, ends - starts) - np.arange(len(rows)) - 1  # each entry pairs with all later ones of its list
    done, total = 0, np.cumsum(after)
    while done < len(rows):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, side="right")))
        count = after[done:stop]
        first = np.repeat(np.arange(done, stop), count)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        yield rows[first], rows[second]
        done = stop


class _Best:
    """The ``k`` best others of each row so far, ties by the order of ids."""

    def __init__(self, ids: list[str], k: int, min_score: float) -> None:
        self.k, self.min_score = k, min_score
        self.order = np.empty(len(ids), dtype=np.int64)
        self.order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        self.row = self.other = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0)

    def add(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.min_score
        if not good.any():
            return
        a, b, score = a[good], b[good], score[good]
        row, other, score = np.concatenate([self.row, a, b]), np.concatenate([self.other, b, a]), np.concatenate([self.score, score, score])
        by = np.lexsort((self.order[other], -score, row))
        row, other, score = row[by], other[by], score[by]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])])
        row, other, score = row[new], other[new], score[new]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = place < self.k
        self.row, self.other, self.score = row[keep], other[keep], score[keep]


def _search_file(pivot: int | None, ids: list[str], side: np.ndarray | None, perms: np.ndarray, vectors: np.ndarray, k: int, min_score: float) -> pa.RecordBatch:
    """The best similar others of each vector posted in one file, or in two parts of it (``side``).

    In the file of one ``pivot`` the vectors that share a second one are candidates; in a file of several (None), or where these
    lists would name each pair more than once, all are.  Candidates are ranked by footrule, and those near enough reranked.
    """
    best = _Best(ids, k, min_score)
    rows, places = np.nonzero(perms[:, :SHARED] != (-1 if pivot is None else pivot))
    second = perms[rows, places]
    by = np.argsort(second, kind="stable")
    rows, second = rows[by], second[by]
    starts = np.flatnonzero(np.concatenate([[True], second[1:] != second[:-1]])) if len(second) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(rows)))
    if pivot is None or perms.shape[1] < SHARED or (lengths * (lengths - 1)).sum() >= len(ids) * (len(ids) - 1):
        rows, starts = np.arange(len(ids)), np.zeros(1, np.int64)
    least = LEAST_FOOTRULE * perms.shape[1] * (perms.shape[1] + 1) / 2
    for a, b in _pairs_of_lists(rows, starts):
        if side is not None:
            differ = side[a] != side[b]
            a, b = a[differ], b[differ]
        near = footrule_similarity(perms, a, b) >= least
        a, b = a[near], b[near]
        for start in range(0, len(a), 100_000):
            x, y = a[start : start + 100_000], b[start : start + 100_000]
            best.add(x, y, np.einsum("ij,ij->i", vectors[x], vectors[y]))
    names = pa.array(ids, pa.string())
    return pa.RecordBatch.from_arrays([names.take(pa.array(best.row)), names.take(pa.array(best.other)), pa.array(best.score)], names=["id", "other", "score"])


class _Files:
    """Which files a vector is posted in: those of its first pivots, or instead of a large one those of the pivot and each other
    pivot of the vector's first ``SHARED``, or instead of a large one of these those of three.

    Two vectors that share a pivot among their first and a second one among their first ``SHARED`` so share a file, unless that
    of the two pivots is large; then they need a third.  A file's number is that of its pivots, smallest first, in base
    ``count``, behind the numbers of files of fewer.
    """

    def __init__(self, count: int) -> None:
        self.count, self.posted = count, min(POSTED, count)
        self.last = 2 if count >= SHARED else 0  # the level of most pivots, from 0
        self.large = [np.zeros(0, np.int64)] * 3  # sorted numbers of the large files of one, two and three pivots
        self.parts = np.zeros(0, np.int64)  # of the large files of most pivots

    def depth(self, file: np.ndarray) -> np.ndarray:
        return 1 + (file >= self.count) + (file >= self.count + self.count**2)

    def _large(self, level: int, file: np.ndarray) -> np.ndarray:
        known = self.large[level]
        at = np.minimum(np.searchsorted(known, file), len(known) - 1)
        return known[at] == file if len(known) else np.zeros(len(file), bool)

    def of(self, perms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and files of the postings of some permutations."""
        row = np.repeat(np.arange(len(perms)), self.posted)
        key = perms[:, : self.posted].astype(np.int64).reshape(-1, 1)  # the pivots of each posting
        done_rows, done_files = [], []
        for level in range(3):
            file = self._number(key)
            big = self._large(level, file) if level < self.last else np.zeros(len(file), bool)
            done_rows.append(row[~big])
            done_files.append(file[~big])
            if not big.any():
                break
            row, key = row[big], key[big]
            more = perms[row, :SHARED].astype(np.int64)
            new = (more[:, :, None] != key[:, None, :]).all(axis=2)
            at, place = np.nonzero(new)
            row, key = row[at], np.sort(np.column_stack([key[at], more[at, place]]), axis=1)
            _, one = np.unique(np.column_stack([row, key]), axis=0, return_index=True)
            row, key = row[one], key[one]
        return np.concatenate(done_rows), np.concatenate(done_files)

    def _number(self, key: np.ndarray) -> np.ndarray:
        number = np.zeros(len(key), np.int64)
        for column in key.T:
            number = number * self.count + column
        return number + sum(self.count**i for i in range(1, key.shape[1]))

    def parts_of(self, file: np.ndarray) -> np.ndarray:
        known = self.large[self.last]
        parts = np.ones(len(file), np.int64)
        big = self._large(self.last, file)
        parts[big] = self.parts[np.searchsorted(known, file[big])]
        return parts


def separate(vectors: np.ndarray, most: int, least: float) -> np.ndarray:
    """Up to ``most`` of the vectors, in their order, none of which is as near to an earlier one as ``least``.

    So a dense cluster holds few pivots, and its members have like permutations instead of accidental ones.
    """
    kept = vectors[:0]
    for start in range(0, len(vectors), 256):
        block = vectors[start : start + 256]
        block = block[(block @ kept.T < least).all(axis=1)] if len(kept) else block
        near = np.tril(block @ block.T >= least, -1)
        own: list[int] = []
        for i in range(len(block)):
            if not near[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, block[own]])[:most]
        if len(kept) >= most:
            break
    return kept


def similar_vectors(vectors: DataFrame, every: DataFrame, rows: int, sample: pa.Table, k: int, size: int = 64, min_score: float = 0.9) -> DataFrame:
    """``id``, ``other``, ``score``: for each vector at least the ``k`` nearest others that the index finds, of a cosine of at least ``min_score``.

    ``vectors`` has a unique ``id`` and a usable ``vector``; ``every`` has the same vectors, repeats included, with a hash ``h1``;
    ``rows`` is the number of vectors or a little more, ``sample`` some of them (:func:`sample_share`) as a table of Arrow.

    Method: pivots are drawn from the sample, none as near to another as 0.8; a vector is the sequence of its ``LENGTH``
    nearest pivots.  It is posted in the inverted files of its first ``POSTED`` pivots, or of several pivots where these would
    be large (:class:`_Files`), one shuffle.  In a file, vectors that share a second pivot are candidates, ranked by footrule,
    and those near enough are reranked by exact cosine; a file gives each vector its ``k`` best there.  How many vectors each
    file has is counted before over all of them, copies once (a sketch for each file), and the tasks are as many as their bytes need.
    """
    spark = vectors.sparkSession
    if not sample.num_rows:
        return spark.createDataFrame([], "id string, other string, score double")
    unit = _unit(sample["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), size)
    unit = np.unique(unit, axis=0)
    unit = unit[np.random.default_rng(7).permutation(len(unit))]
    pivots = np.ascontiguousarray(separate(unit, most_pivots(rows), 0.8), dtype=np.float32)
    files = _Files(len(pivots))
    fitted = spark.sparkContext.broadcast(pivots)
    total = 0
    for level in range(files.last + 1):

        def tally(batches: Iterator[pa.RecordBatch], files=files, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    perms = _permutations(_unit(batch.column(0).flatten().to_numpy(zero_copy_only=False), size), fitted.value, LENGTH if level else files.posted)
                    row, file = files.of(perms)
                    own = files.depth(file) == level + 1
                    yield pa.RecordBatch.from_arrays([pa.array(file[own]), batch.column(1).take(pa.array(row[own]))], names=["file", "h1"])

        counted = every.select("vector", "h1").mapInArrow(tally, "file long, h1 long").groupBy("file").agg(F.approx_count_distinct("h1", 0.08).alias("n"))
        limit = max(FILE_ROWS, -(-(POSTED, 24, 120)[level] * rows // LARGE_FILES))
        if not level:
            counted = counted.toArrow()  # a row for each pivot
            total = sum(counted["n"].to_pylist())
            large = counted.filter(pc.greater(counted["n"], limit))
        else:
            large = counted.where(F.col("n") > limit).toArrow()  # at most LARGE_FILES rows
        large = large.sort_by("file")
        files.large[level], n = large["file"].to_numpy(), large["n"].to_numpy()
        if not len(n):
            break
        if level == files.last:
            files.parts = -(-n // FILE_ROWS)
            total += int((n * (files.parts - 1)).sum())
        else:
            total += (SHARED - 1 - level) * int(n.sum())
    tasks = max(spark.sparkContext.defaultParallelism, -(-total * (size * 4 + 60) // TASK_BYTES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            perms = _permutations(_unit(batch.column(1).flatten().to_numpy(zero_copy_only=False), size), fitted.value, LENGTH)
            row, file = files.of(perms)
            parts = files.parts_of(file)
            own = batch.column(2).to_numpy()[row] % parts
            # A vector goes to its own part with every part.
            again = np.repeat(np.arange(len(row)), parts)
            other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
            row, file, own = row[again], file[again], own[again]
            low, high, own = (pa.array(x.astype(np.int32)) for x in (np.minimum(own, other), np.maximum(own, other), own))
            take = pa.array(row)
            perm = pa.FixedSizeBinaryArray.from_buffers(pa.binary(perms.shape[1] * 2), len(perms), [None, pa.py_buffer(np.ascontiguousarray(perms, dtype=np.int16))]).cast(pa.binary())
            plain = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
            vector = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * 4), len(perms), [None, pa.py_buffer(plain)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(file), low, high, own, batch.column(0).take(take), perm.take(take), vector.take(take)], names=["file", "low", "high", "own", "id", "perm", "vector"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            file, low, high = (rows.column(i)[0].as_py() for i in range(3))
            perms = np.frombuffer(b"".join(rows["perm"].to_pylist()), dtype=np.int16).reshape(rows.num_rows, -1)
            unit = _unit(np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=np.float32), size)
            side = rows["own"].to_numpy() if low != high else None
            yield _search_file(file if file < files.count else None, rows["id"].to_pylist(), side, perms, unit, k, min_score)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                key = tuple(keys[:, a])
                if held and key != last:
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from flush(pa.Table.from_batches(held))

    posts = vectors.select("id", "vector", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)).cast("int").alias("part")).mapInArrow(
        post, "file long, low int, high int, own int, id string, perm binary, vector binary"
    )
    posted = posts.repartition(tasks, "file", "low", "high").sortWithinPartitions("file", "low", "high")
    return posted.mapInArrow(search, "id string, other string, score double").groupBy("id", "other").agg(F.max("score").alias("score"))


def most_pivots(rows: int) -> int:
    return max(2, min(MOST_PIVOTS, math.ceil(2 * math.sqrt(rows))))


def sample_share(rows: int) -> float:
    """The share of the rows on which the index is fitted."""
    return min(1.0, max(FIT_ROWS, FIT_FOR_PIVOT * most_pivots(rows)) / max(rows, 1))


def nearest_vectors(chunks: DataFrame, k: int = 5, min_score: float = 0.9, size: int = 64, **columns) -> DataFrame:
    """``id``, ``neighbour``, ``score``, ``place``: the ``k`` others of greatest cosine of every chunk, as far as it is at least ``min_score``.

    Equal cosines rank by id.  Equal vectors are one class in the index (its smallest id), so that copies, however many, are
    never compared; then each member gets the first ``k + 1`` members of its own class and the first ``k`` of similar ones,
    which is all that can be among its nearest.

    Rows with null ids or unusable vectors take no part (:func:`usable`); of several versions the latest usable one
    counts; repeated rows count once; empty tables give no rows.  Scaled vectors are equally similar.  Other columns aren't read.
    """
    rows = usable_vectors(chunks, size, **columns)
    # First only ids and hashes: each chunk's latest version, and the classes of equal vectors.
    latest = written(rows.groupBy("id").agg(F.max(F.struct("version", "h1", "h2")).alias("last")).select("id", "last.h1", "last.h2"), "latest")
    classes = latest.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("members"))
    count = latest.count()
    # The sample: versions whose hash is below a bound, so about as many as wanted wherever they are.
    bound = int(sample_share(count) * (1 << 40))
    sample = rows.where(F.pmod(F.xxhash64("id", "h1", "h2", F.lit(2)), F.lit(1 << 40)) < bound).limit(2 * max(FIT_ROWS, FIT_FOR_PIVOT * MOST_PIVOTS)).select("vector").toArrow()
    vectors = rows.drop("version").join(classes.drop("members"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"])
    both = written(similar_vectors(vectors, rows, count, sample, k, size, min_score).withColumnRenamed("id", "rep"), "similar")
    copied = classes.where("members > 1").withColumnRenamed("id", "rep")
    own = copied.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("score"))
    similar = both.unionByName(own)
    members = latest.join(classes.select("h1", "h2", F.col("id").alias("rep"), "members"), ["h1", "h2"]).select("rep", "id", "members")
    first = _first_members(members.where("members > 1").select("rep", "id"), k + 1)
    listed = similar.join(first.withColumnRenamed("rep", "other"), "other", "left").select("rep", "score", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbour"))
    # The k + 1 best candidates of each class: enough for any member, itself included.
    best = listed.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "neighbour"))).where(F.col("place") <= k + 1)
    # Every vector is a member of its class, so this is an inner join, in which a class of very many members can be split.
    asked = best.join(members.select("rep", "id"), "rep").select("id", "neighbour", "score").where("id <> neighbour")
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return asked.withColumn("place", place).where(F.col("place") <= k)


def _first_members(members: DataFrame, count: int) -> DataFrame:
    """``rep``, ``ids``: the first members of each class; each partition keeps no more than ``count`` of a class."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["rep", "salt"], ["rep"]):
        salted = salted.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= count).drop("n")
    return salted.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def found_pairs(chunks: DataFrame, k: int = 5, min_score: float = 0.9) -> DataFrame:
    """``chunk_a < chunk_b``: one is among the ``k`` nearest others of the other, and their cosine is at least ``min_score``."""
    near = nearest_vectors(chunks, k, min_score)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
