"""Queries of hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import search as S
from lorespan.plans.claims import _RANKS, ranked_pages
from lorespan.plans.text import _BODY, _FRONT, _TITLE, sql_tokens
from lorespan.session import table, written

QUERY = "retrieval index claim"
#: The words of the query (:func:`T.query_tokens`); a query of stop words alone is one word.
WORDS = ["retrieval", "index", "claim"]

#: Results of a search, pages of its vector and graph streams, and chunks fetched for the former.
RESULTS, VECTOR_PAGES, GRAPH_PAGES, FETCHED = 20, 10, 12, 30

#: Characters of chunks that the context of a search holds.
BUDGET = 600


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", "text", "page_path")


def _fields() -> dict:
    """The fields of a page with its front matter in the column ``front``."""
    text, path, front = F.col("text"), F.col("page_path"), F.col("front")
    return {
        "filename": T.file_stem(path), "title": T.page_title(text, path), "body": T.page_body(text),
        "aliases": F.array_join(T.front_entries(front, "alias", "aliases"), " "), "keywords": F.array_join(T.front_entries(front, "keywords", "tags"), " "),
    }


FIELDS = list(S.FIELD_WEIGHTS)


def _with_front(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).withColumn("front", T.front_matter(F.col("text")))


def _counted(spark: SparkSession, folder: str, *also: Column) -> DataFrame:
    """One pass over the texts: per page the counts that BM25 needs, and other columns."""
    return written(_with_front(spark, folder).select("doc_id", *also, *S.bm25_counts(_fields(), WORDS)), "counted")


def bm25_stats(spark: SparkSession, folder: str) -> DataFrame:
    return S.bm25_stats(S.field_rows(_with_front(spark, folder), _fields()))


def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    return S.bm25(_counted(spark, folder), FIELDS, WORDS).select("doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bm25_scores(spark, folder).orderBy(F.desc("score"), "doc_id").limit(20)


def bm25_explain(spark: SparkSession, folder: str) -> DataFrame:
    scored = S.bm25(_counted(spark, folder), FIELDS, WORDS)
    return scored.select("doc_id", F.explode("by_field").alias("field", "part")).select("doc_id", "field", F.round("part", 6).alias("part"))


def lexical_score(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("doc_id", S.lexical(QUERY, WORDS).alias("score")).where("score > 0")


def vector_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by their chunks nearest to a query vector, that of the first chunk whose id names an index: ``page``, ``score``, ``place``."""
    rows = table(spark, folder, "chunk_vectors").where(F.expr("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"))
    latest = written(rows.groupBy("chunk_id").agg(F.max(F.struct("upserted_at", "embedding"))["embedding"].cast("array<double>").alias("v")), "latest")
    query = latest.where(F.contains("chunk_id", F.lit("index"))).agg(F.min_by("v", "chunk_id").alias("q"))
    hits = S.nearest_to(latest, query, FETCHED).select(F.substring_index("chunk_id", "#", 1).alias("page"), "score")
    return S.pooled(hits, "page").select("page", F.round("page_score", 6).alias("score")).orderBy(F.desc("score"), "page").limit(VECTOR_PAGES)


def rrf_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best pages of four streams: words (the lexical score, or BM25 where that finds nothing), vectors, and typed links."""
    counted = _counted(spark, folder, T.file_stem(F.col("page_path")).alias("page"), S.lexical(QUERY, WORDS).alias("lexical"))
    scores = S.bm25(counted, FIELDS, WORDS).select("doc_id", F.round("score", 6).alias("score"))
    streams = [S.ranked(counted.where("lexical > 0").select("doc_id", F.col("lexical").alias("score")), "lexical"), S.ranked(scores, "bm25")]
    for name, found in (("vector", vector_pages(spark, folder)), ("graph", ranked_pages(spark, folder, QUERY, WORDS).select(F.col("id").alias("page"), "score"))):
        place = F.row_number().over(W.orderBy(F.desc("score"), "page"))  # a dozen rows
        few = found.select("page", F.lit(name).alias("stream"), place.cast("long").alias("place"))
        streams.append(counted.select("doc_id", "page").join(F.broadcast(few), "page").select("doc_id", "stream", "place"))
    fused = S.fuse(streams, instead={"bm25": "lexical"})
    places = [F.col("places")[name].cast("int").alias(f"{name}_place") for name in ("lexical", "bm25", "vector", "graph")]
    return fused.select("doc_id", F.round("score", 8).alias("score"), *places).orderBy(F.desc("score"), "doc_id").limit(RESULTS)


def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return S.nearest(rows, rows.where("vec_id % 100 = 0"), 10).select("query", "vec_id", F.round("distance", 6).alias("distance"), "place")


def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return S.nearest(rows, rows.where("vec_id % 100 = 0"), 10, metric="cosine").select("query", "vec_id", F.round("distance", 6).alias("distance"), "place")


def chunk_pool_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of earlier searches pooled to pages, best first in each search."""
    hits = table(spark, folder, "chunk_search_results").where("score is not null").distinct()
    whole = S.pooled(hits.select(F.struct("query_chunk_id", "page_id").alias("page"), F.col("score").cast("double").alias("score")), "page")
    place = F.row_number().over(W.partitionBy("page.query_chunk_id").orderBy(F.desc(F.round("page_score", 6)), "page.page_id"))
    return whole.select("page.query_chunk_id", "page.page_id", F.round("page_score", 6).alias("page_score"), "chunks", place.alias("place"))


def search_score_check(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of earlier searches against 1 / (1 + distance) of the chunks' latest vectors: right, stale or missing."""
    chunks = table(spark, folder, "chunk_vectors").where("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    latest = chunks.groupBy("chunk_id").agg(F.max(F.struct("upserted_at", "embedding"))["embedding"].cast("array<double>").alias("v"))
    hits = table(spark, folder, "chunk_search_results").distinct()
    both = hits.join(latest.withColumnsRenamed({"chunk_id": "query_chunk_id", "v": "q"}), "query_chunk_id", "left").join(latest, "chunk_id", "left")
    distance = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    score = F.lit(1.0) / (F.lit(1.0) + distance)
    state = F.when(F.col("q").isNull() | F.col("v").isNull(), "missing").when(F.col("score").isNull(), "unscored").when(F.abs(score - F.col("score")) < 1e-4, "right").otherwise("stale")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("hits"), F.countDistinct("search_id").alias("searches"))


def context_budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each earlier search packed into a budget, best first; a page that doesn't fit is skipped, the next one tried."""
    pools = chunk_pool_pages(spark, folder)
    sizes = table(spark, folder, "chunk_vectors").where("chunk_text is not null").select("page_id", "chunk_id", F.length("chunk_text").alias("n")).groupBy("page_id", "chunk_id").agg(F.max("n").alias("n"))
    sized = pools.join(sizes.groupBy("page_id").agg(F.sum("n").alias("n")), "page_id")
    listed = sized.groupBy("query_chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "page_id", "n"))).alias("all"))
    fold = F.aggregate(
        "all", F.struct(F.lit(BUDGET).cast("long").alias("left"), F.expr("cast(array() as array<string>)").alias("taken")),
        lambda s, x: F.when(x["n"] <= s["left"], F.struct((s["left"] - x["n"]).alias("left"), F.array_append(s["taken"], x["page_id"]).alias("taken"))).otherwise(s),
    )
    return listed.select("query_chunk_id", fold.alias("f")).select("query_chunk_id", F.size("f.taken").alias("pages"), (F.lit(BUDGET) - F.col("f.left")).alias("used"))


QUERIES = {f.__name__: f for f in (bm25_stats, bm25_scores, bm25_topk, bm25_explain, lexical_score, rrf_search, vector_pages, knn_l2, knn_cosine, chunk_pool_pages, search_score_check, context_budget_pack)}

_P = "p AS (SELECT doc_id, text, page_path FROM documents WHERE text IS NOT NULL)"
_STEM = r"regexp_replace(regexp_replace(page_path, '^.*/', ''), '\.md$', '')"
_entries = lambda *names: f"SELECT doc_id, unnest({sql_tokens('value')}) AS token FROM (SELECT doc_id, string_agg(value, ' ' ORDER BY line, pos) AS value FROM (SELECT doc_id, line, unnest(entries) AS value, unnest(generate_series(1, len(entries))) AS pos FROM fm WHERE lower(field) IN {names!r}) GROUP BY doc_id)"
_TOKENS = f"""{_P}, {_FRONT}, t AS (SELECT doc_id, 'filename' AS field, unnest({sql_tokens(_STEM)}) AS token FROM p WHERE page_path IS NOT NULL
  UNION ALL SELECT doc_id, 'title', unnest({sql_tokens('title')}) FROM (SELECT *, {_TITLE} AS title FROM p) UNION ALL SELECT doc_id, 'body', unnest({sql_tokens('text')}) FROM (SELECT doc_id, {_BODY} AS text FROM p)
  UNION ALL SELECT doc_id, 'aliases', token FROM ({_entries('alias', 'aliases')}) UNION ALL SELECT doc_id, 'keywords', token FROM ({_entries('keywords', 'tags')}))"""
_BM25 = f"""{_TOKENS}, q AS (SELECT unnest({WORDS!r}) AS token),
len AS (SELECT doc_id, field, count(*) AS length FROM t GROUP BY ALL), tf AS (SELECT doc_id, field, token, count(*) AS tf FROM t JOIN q USING (token) GROUP BY ALL),
df AS (SELECT field, token, count(*) AS df FROM tf GROUP BY ALL), av AS (SELECT field, sum(length) / (SELECT count(*) FROM p)::DOUBLE AS av FROM len GROUP BY field),
parts AS (SELECT doc_id, field, CASE field {' '.join(f"WHEN '{f}' THEN {w}e0" for f, w in S.FIELD_WEIGHTS.items())} END * sum(ln(1e0 + (n.n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / av))) AS part
  FROM tf JOIN df USING (field, token) JOIN len USING (doc_id, field) JOIN av USING (field), (SELECT count(*) AS n FROM p) n GROUP BY doc_id, field),
bm AS (SELECT doc_id, round(sum(part), 6) AS score FROM parts GROUP BY doc_id)"""
_any = lambda where: " + ".join(f"contains({where}, '{w}')::INT" for w in WORDS)
_LEX = f"""lex AS (SELECT * FROM (SELECT doc_id, (coalesce((stem = '{QUERY}')::INT, 0) * 200 + contains(tl, '{QUERY}')::INT * 50 + least((length(body) - length(replace(body, '{QUERY}', ''))) // {len(QUERY)}, 10) * 20 + ({_any('tl')}) * 5 + ({_any('body')}))::INT AS score
  FROM (SELECT doc_id, lower({_STEM}) AS stem, lower(concat_ws(' ', {_TITLE}, regexp_replace(page_path, '^.*/', ''))) AS tl, lower(text) AS body FROM p)) WHERE score > 0)"""
_KNN = lambda d: f"""SELECT query, vec_id, round(distance, 6) AS distance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS place FROM (SELECT q.vec_id AS query, e.vec_id, {d} AS distance
  FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON e.vec_id <> q.vec_id)) WHERE place <= 10"""  # noqa: E731

_VEC = """lv AS (SELECT chunk_id, arg_max(embedding::DOUBLE[], upserted_at) AS v FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY chunk_id),
vh AS (SELECT split_part(chunk_id, '#', 1) AS page, score FROM (SELECT chunk_id, round(1 / (1 + list_distance(v, (SELECT arg_min(v, chunk_id) FROM lv WHERE contains(chunk_id, 'index')))), 9) AS score FROM lv ORDER BY score DESC, chunk_id LIMIT 30)),
vec AS (SELECT page, round(max(score) + least(0.3e0 * (sum(score) - max(score)), greatest(0, 1 - max(score))), 6) AS score FROM vh GROUP BY page ORDER BY score DESC, page LIMIT 10)"""

SQL = {
    "bm25_stats": f"WITH {_TOKENS} SELECT field, token, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL",
    "bm25_scores": f"WITH {_BM25} SELECT * FROM bm",
    "bm25_topk": f"WITH {_BM25} SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20",
    "bm25_explain": f"WITH {_BM25} SELECT doc_id, field, round(part, 6) AS part FROM parts",
    "lexical_score": f"WITH {_P}, {_LEX} SELECT * FROM lex",
    "vector_pages": f"WITH {_VEC} SELECT page, score FROM vec",
    "rrf_search": f"""WITH {_BM25}, {_LEX}, {_VEC}, {_RANKS(QUERY, WORDS)}, sp AS (SELECT doc_id, {_STEM} AS page FROM p),
x AS (SELECT doc_id, 'l' AS stream, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM lex UNION ALL SELECT doc_id, 'b', row_number() OVER (ORDER BY score DESC, doc_id) FROM bm
  UNION ALL SELECT doc_id, 'v', place FROM sp JOIN (SELECT page, row_number() OVER (ORDER BY score DESC, page) AS place FROM vec) USING (page) UNION ALL SELECT doc_id, 'g', place FROM sp JOIN (SELECT id AS page, row_number() OVER (ORDER BY score DESC, id) AS place FROM tr) USING (page)),
y AS (SELECT doc_id, max(place) FILTER (WHERE stream = 'l') AS l, max(place) FILTER (WHERE stream = 'b') AS b, max(place) FILTER (WHERE stream = 'v') AS v, max(place) FILTER (WHERE stream = 'g') AS g FROM x GROUP BY doc_id)
SELECT doc_id, round(coalesce(1e0 / (60 + coalesce(l, b)), 0) + coalesce(1e0 / (60 + v), 0) + coalesce(1e0 / (60 + g), 0), 8) AS score, l::INT AS lexical_place, b::INT AS bm25_place, v::INT AS vector_place, g::INT AS graph_place FROM y ORDER BY score DESC, doc_id LIMIT 20""",
    "knn_l2": _KNN("list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"),
    "knn_cosine": _KNN("1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"),
    "chunk_pool_pages": """SELECT query_chunk_id, page_id, page_score, chunks, row_number() OVER (PARTITION BY query_chunk_id ORDER BY page_score DESC, page_id)::INT AS place FROM (
  SELECT query_chunk_id, page_id, round(max(score) + least(0.3e0 * (sum(score) - max(score)), greatest(0, 1 - max(score))), 6) AS page_score, count(*) AS chunks FROM (SELECT DISTINCT * REPLACE (score::DOUBLE AS score) FROM chunk_search_results WHERE score IS NOT NULL) GROUP BY ALL)""",
    "search_score_check": """WITH l AS (SELECT chunk_id, arg_max(embedding::DOUBLE[], upserted_at) AS v FROM chunk_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY chunk_id)
SELECT CASE WHEN q.v IS NULL OR l.v IS NULL THEN 'missing' WHEN score IS NULL THEN 'unscored' WHEN abs(1 / (1 + list_distance(q.v, l.v)) - score) < 1e-4 THEN 'right' ELSE 'stale' END AS state, count(*) AS hits, count(DISTINCT search_id) AS searches
FROM (SELECT DISTINCT * FROM chunk_search_results) h LEFT JOIN l q ON q.chunk_id = h.query_chunk_id LEFT JOIN l ON l.chunk_id = h.chunk_id GROUP BY state""",
}
SQL["context_budget_pack"] = f"""WITH pool AS ({SQL['chunk_pool_pages']}), z AS (SELECT page_id, chunk_id, max(length(chunk_text)) AS n FROM chunk_vectors WHERE chunk_text IS NOT NULL GROUP BY ALL), y AS (SELECT page_id, sum(n)::BIGINT AS n FROM z GROUP BY page_id),
l AS (SELECT query_chunk_id, list_reduce([0::BIGINT] || list(n ORDER BY place, page_id), lambda done, n: CASE WHEN done // 100000 + n <= {BUDGET} THEN done + n * 100000 + 1 ELSE done END) AS f FROM pool JOIN y USING (page_id) GROUP BY query_chunk_id)
SELECT query_chunk_id, (f % 100000)::INT AS pages, f // 100000 AS used FROM l"""
