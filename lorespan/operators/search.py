"""Hybrid retrieval: BM25 over fields, lexical scores, nearest vectors, pooling, rank fusion."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.session import numbered

#: Weights of the fields, and the two constants of BM25.
FIELD_WEIGHTS = {"filename": 4.0, "title": 3.0, "aliases": 2.5, "keywords": 2.0, "body": 1.0}
K1, B = 1.2, 0.75

#: Weights of the lexical score.
FILENAME_EXACT, PHRASE_IN_TITLE, PHRASE_IN_CONTENT, MOST_PHRASES, TITLE_TOKEN, CONTENT_TOKEN = 200, 50, 20, 10, 5, 1

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60

#: Queries that one pass of a vector search holds.
QUERIES_PER_PASS = 4096


def field_rows(pages: DataFrame, fields: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``field``, ``token``: the words of every field of every page, repeats included."""
    values = F.array(*(F.struct(F.lit(name).alias("field"), value.alias("text")) for name, value in fields.items()))
    rows = pages.select(F.col(id_col), F.explode(values).alias("f")).select(id_col, "f.field", F.col("f.text").alias("text")).where("text is not null")
    return T.token_rows(rows, "text")


def bm25_stats(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``field``, ``token``, ``df``: in how many pages a word stands, by field."""
    return tokens.groupBy("field", "token", id_col).count().groupBy("field", "token").agg(F.count("*").alias("df"))


def bm25_counts(fields: dict[str, Column], query: list[str]) -> list[Column]:
    """A column for each field with its number of words and how often each query word is among them (:func:`T.token_counts`)."""
    return [T.token_counts(F.coalesce(value, F.lit("")), query).alias(name) for name, value in fields.items()]


def bm25(counted: DataFrame, fields: list[str], query: list[str], id_col: str = "doc_id", weights: dict[str, float] = FIELD_WEIGHTS, k1: float = K1, b: float = B) -> DataFrame:
    """``id_col``, ``score`` and a map ``by_field`` of the pages in which a query word stands.

    ``counted`` has a row for each page with the columns of :func:`bm25_counts`; it is read twice, once for the statistics of
    the collection, which are one row, so no page is shuffled.
    """
    words = range(len(query))
    sums = [F.sum(f"{f}.length").alias(f"total_{f}") for f in fields] + [F.count_if(F.col(f"{f}.tf")[i] > 0).alias(f"df_{f}_{i}") for f in fields for i in words]
    stats = counted.agg(F.count("*").alias("n"), *sums)

    def part(f: str) -> Column:
        score, average = F.lit(0.0), F.col(f"total_{f}") / F.col("n")
        for i in words:
            tf, df = F.col(f"{f}.tf")[i], F.col(f"df_{f}_{i}")
            idf = F.ln(F.lit(1.0) + (F.col("n") - df + F.lit(0.5)) / (df + F.lit(0.5)))
            score += F.when(tf > 0, idf * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col(f"{f}.length") / average))).otherwise(F.lit(0.0))
        return F.lit(weights[f]) * score

    hit = F.exists(F.array(*(F.array_max(F.col(f"{f}.tf")) for f in fields)), lambda most: most > 0)
    scored = counted.where(hit).join(F.broadcast(stats)).select(id_col, *(part(f).alias(f) for f in fields))
    parts = F.filter(F.array(*(F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in sorted(fields))), lambda x: x["value"] > 0)
    return scored.select(id_col, sum((F.col(f) for f in fields), F.lit(0.0)).alias("score"), F.map_from_entries(parts).alias("by_field"))


def lexical(query: str, words: list[str], text: str = "text", path: str = "page_path") -> Column:
    """The score of a page whose name, title or text holds the phrase, or any of its words as a substring; 0 for others."""
    phrase = query.strip().lower()
    stem = F.lower(T.file_stem(F.col(path)))
    title = F.lower(F.concat_ws(" ", T.page_title(F.col(text), F.col(path)), F.regexp_replace(path, r"^.*/", "")))
    body = F.lower(text)
    any_of = lambda where: sum((F.contains(where, F.lit(w)).cast("int") for w in words), F.lit(0))
    return (
        F.coalesce(stem == phrase, F.lit(False)).cast("int") * FILENAME_EXACT
        + F.contains(title, F.lit(phrase)).cast("int") * PHRASE_IN_TITLE
        + F.least(T.occurrences(body, phrase), F.lit(MOST_PHRASES)) * PHRASE_IN_CONTENT
        + any_of(title) * TITLE_TOKEN
        + any_of(body) * CONTENT_TOKEN
    )


def ranked(scores: DataFrame, stream: str, id_col: str = "doc_id") -> DataFrame:
    """All of one stream with their places, best first: ``id_col``, ``stream``, ``place``; see :func:`numbered`."""
    placed, _ = numbered(scores.select(id_col, "score"), F.desc("score"), id_col, name="place")
    return placed.select(id_col, F.lit(stream).alias("stream"), "place")


def _other_than(stream: str):
    return lambda name, _: name != stream


def fuse(streams: list[DataFrame], id_col: str = "doc_id", k: int = RRF_K, instead: dict[str, str] | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``id_col``, ``score`` and ``places``, a map from the streams that found the page to its place.

    ``instead`` names streams that count only for pages that another one hasn't found.
    """
    together = streams[0]
    for s in streams[1:]:
        together = together.unionByName(s)
    placed = together.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", "place")))).alias("places"))  # one entry for each stream
    counted = F.col("places")
    for stream, other in (instead or {}).items():
        counted = F.when(F.map_contains_key("places", other), F.map_filter(counted, _other_than(stream))).otherwise(counted)
    score = F.aggregate(F.array_sort(F.map_values(counted)), F.lit(0.0), lambda sum_, place: sum_ + F.lit(1.0) / (F.lit(k) + place))
    return placed.select(id_col, score.alias("score"), "places")


def nearest_to(vectors: DataFrame, query: DataFrame, most: int, id_col: str = "chunk_id", vector_col: str = "v") -> DataFrame:
    """``id_col``, ``score``: the ``most`` vectors nearest to one query vector (``query`` has one row ``q``), scored 1 / (1 + distance); of equal ones the first ids."""
    distance = F.sqrt(F.aggregate(F.zip_with("q", vector_col, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = vectors.join(F.broadcast(query)).select(id_col, F.round(F.lit(1.0) / (F.lit(1.0) + distance), 9).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(most)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """``query``, ``id_col``, ``distance``, ``place``: for each of a stated set of queries the ``k`` nearest other vectors, exactly.

    Queries go to the tasks in passes of at most ``QUERIES_PER_PASS``; each task compares its rows with them block by block
    and keeps its own ``k`` best of each query, so that is all that is shuffled.  ``metric`` is ``l2`` or ``cosine``.
    """
    spark = vectors.sparkSession
    wanted = queries.select(queries[id_col].cast("long").alias("q"), queries[vector_col].cast("array<double>").alias("v"))
    passes = max(1, -(-wanted.count() // QUERIES_PER_PASS))
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    found = None
    for part in range(passes):
        own = wanted.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == part).toArrow()
        asked = spark.sparkContext.broadcast((own["q"].to_numpy(), np.array(own["v"].to_pylist(), dtype=np.float64)))

        def compare(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            names, q = asked.value
            best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if metric == "l2":
                    d = np.sqrt(np.stack([((x - one) ** 2).sum(axis=1) for one in q]))
                else:
                    d = 1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
                d[names[:, None] == ids[None, :]] = np.inf
                for i in range(len(names)):
                    far, who = np.concatenate([best[i][0], d[i]]), np.concatenate([best[i][1], ids])
                    keep = np.lexsort((who, far))[:k]
                    best[i] = far[keep], who[keep]
            for name, (far, who) in zip(names.tolist(), best):
                real = np.isfinite(far)
                yield pa.RecordBatch.from_arrays([pa.array([name] * int(real.sum()), pa.int64()), pa.array(who[real]), pa.array(far[real])], names=["query", "id", "distance"])

        one = rows.mapInArrow(compare, "query long, id long, distance double")
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("id", id_col)


def pooled(hits: DataFrame, page: str, score: str = "score") -> DataFrame:
    """Chunk hits pooled to pages: the best score, and 0.3 times the sum of the others as far as it stays within 1."""
    rest = F.least(F.lit(0.3) * (F.sum(score) - F.max(score)), F.greatest(F.lit(0.0), F.lit(1.0) - F.max(score)))
    return hits.groupBy(page).agg((F.max(score) + rest).alias("page_score"), F.count("*").alias("chunks"))
