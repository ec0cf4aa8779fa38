"""Queries on claims and their evidence; a summary's description is a claim of its page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import evidence as E
from lorespan.operators import governance as Q
from lorespan.plans import graph, search
from lorespan.plans.text import SQL as _TEXT_SQL
from lorespan.plans.text import _FRONT
from lorespan.session import table, written

TODAY = "2026-07-01"


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """``claim_id``, ``project_id``, ``path``, ``text``, ``confidence``, ``status``."""
    rows = table(spark, folder, "entity_summaries").where("trim(description) <> '' and page_path is not null").dropDuplicates(["summary_id"])
    tier = Q.lookup(Q.TIER_OF_TYPE, F.coalesce(F.lower(F.trim("page_type")), F.lit("")), "working")
    scored = Q.lifecycle(rows, tier, F.lit(1), F.lit(0), F.col("extracted_at"), TODAY)
    return scored.select(F.col("summary_id").alias("claim_id"), "project_id", E.comparable_path(F.col("page_path")).alias("path"), F.col("description").alias("text"), "confidence", "status")


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """The results of a search by path, each at its first place."""
    found = written(search.rrf_search(spark, folder), "results")
    placed = found.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))).select("doc_id", "place")  # a page of results
    paths = table(spark, folder, "documents").where("page_path is not null").select("doc_id", "page_path").join(F.broadcast(placed), "doc_id")
    return written(paths.groupBy(E.comparable_path(F.col("page_path")).alias("path")).agg(F.min("place").alias("place")), "places")


def claim_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return E.claim_evidence(claims(spark, folder), _results(spark, folder), search.WORDS)


def orphan_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims whose page is not there any more."""
    pages = table(spark, folder, "retrieval_nodes").where("deleted_at is null and page_path is not null").select("project_id", E.comparable_path(F.col("page_path")).alias("path"))
    return claims(spark, folder).join(pages, ["project_id", "path"], "left_anti").select("claim_id", "path")


def snippet_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that pages state, and the snippet of any of the page's texts that bears each best."""
    docs = table(spark, folder, "documents", spread=True).where("text is not null and page_path is not null").select("doc_id", E.comparable_path(F.col("page_path")).alias("path"), "text")
    stated = docs.select("doc_id", "path", F.posexplode(T.sentences_with_signal(F.col("text"))).alias("place", "claim"))
    return E.snippet_provenance(stated.select(F.concat_ws("#", "doc_id", "place").alias("claim_id"), "path", F.col("claim").alias("text")), docs)


def dedup_rewrites(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", spread=True).where("text is not null")
    return E.reference_rewrites(docs, E.redirects(table(spark, folder, "merge_requests")))


def graph_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Related pages of the results of a search."""
    hits = _results(spark, folder).groupBy(T.file_stem(F.col("path")).alias("id")).agg(F.min("place").alias("place"))
    return E.expanded(written(hits, "hits"), graph.related_topk(spark, folder))


QUERIES = {f.__name__: f for f in (claim_evidence, orphan_claims, snippet_provenance, dedup_rewrites, graph_expansion)}

_path = lambda c: rf"regexp_replace(replace({c}, '\', '/'), '(?s)\A.*?/(wiki/)', '\1')"
_form = lambda c: rf"regexp_replace(lower({c}), '[ \t\r\n\-_]+', '', 'g')"
_tier = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in Q.TIER_OF_TYPE.items()) + " ELSE 'working' END"
_CLAIMS = f"""cz AS (SELECT *, {_tier} AS tier, greatest(date_diff('day', extracted_at::DATE, DATE '{TODAY}'), 0) AS age FROM (SELECT *, coalesce(lower(trim(page_type, ' ')), '') AS t FROM (SELECT DISTINCT * FROM entity_summaries)) WHERE trim(description, ' ') <> '' AND page_path IS NOT NULL),
cy AS (SELECT *, CASE tier WHEN 'semantic' THEN 180 WHEN 'procedural' THEN 365 ELSE 45 END AS half, CASE tier {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in Q.TIER_SCORE.items())} END AS ts FROM cz),
cx AS (SELECT *, greatest(0e0, least(1e0, 0.45e0 + ts + 0.07e0 - CASE WHEN least(0.22e0, age / half::DOUBLE * 0.08e0) > 0.005 THEN least(0.22e0, age / half::DOUBLE * 0.08e0) ELSE 0e0 END)) AS confidence FROM cy),
c AS (SELECT summary_id AS claim_id, project_id, {_path('page_path')} AS path, description AS text, confidence, CASE WHEN age > half * 2 THEN 'stale' WHEN confidence < 0.45 THEN 'needs-review' ELSE 'ok' END AS status FROM cx)"""
_PLACES = f"""rr AS ({search.SQL['rrf_search']}), rp AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM rr),
pl AS (SELECT {_path('page_path')} AS path, min(place) AS place FROM rp JOIN documents USING (doc_id) WHERE page_path IS NOT NULL GROUP BY 1)"""
_plain = lambda c: rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\-]+', ' ', 'g'), ' ')"
_han = lambda c: f"regexp_extract_all({c}, '[\\x{{3400}}-\\x{{9fff}}]')"
_over = lambda c: f"list_distinct(regexp_extract_all({c}, '[a-z0-9][a-z0-9-]+') || list_transform(generate_series(1, len({_han(c)}) - 1), lambda i: {_han(c)}[i] || {_han(c)}[i + 1]))"
_white = "' ' || chr(9) || chr(13) || chr(10)"
_filled = lambda xs: f"list_filter(list_transform({xs}, lambda s: trim(s, {_white})), lambda s: s <> '')"
_windows = lambda w: f"CASE WHEN length({w}) <= {E.SNIPPET} THEN [{w}] ELSE {_filled(f'list_transform(range(0, length({w}), {E.STEP}), lambda i: substring({w}, i + 1, {E.SNIPPET}))')} END"
_pack = f"""list_reduce({_filled(f"regexp_split_to_array(regexp_replace(b, '{E.SENTENCE}', '\\1' || chr(10), 'g'), '\\n+')")}, lambda done, s: CASE WHEN length(string_split(done, chr(30))[-1]) + 1 + length(s) <= {E.SNIPPET} THEN done || ' ' || s ELSE done || chr(30) || s END)"""

SQL = {
    "claim_evidence": f"""WITH {_CLAIMS}, {_PLACES} SELECT claim_id, path, round(1e0 / greatest(1, place) + n / {len(search.WORDS)}e0 + confidence * 0.35e0 + CASE status {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in E.STATUS_WEIGHTS.items())} ELSE -0.25e0 END, 6) AS score, matched
FROM (SELECT c.*, place, array_to_string(m, ' ') AS matched, len(m) AS n FROM (SELECT *, list_filter({search.WORDS!r}, lambda w: contains(lower(text), w)) AS m FROM c) c JOIN pl USING (path)) ORDER BY score DESC, claim_id LIMIT 10""",
    "orphan_claims": f"WITH {_CLAIMS} SELECT claim_id, path FROM c ANTI JOIN (SELECT project_id, {_path('page_path')} AS path FROM retrieval_nodes WHERE deleted_at IS NULL AND page_path IS NOT NULL) p USING (project_id, path)",
    "snippet_provenance": f"""WITH cl AS ({_TEXT_SQL['claim_lines']}), c AS (SELECT concat(doc_id, '#', place) AS claim_id, {_path('page_path')} AS path, claim AS text FROM cl JOIN documents USING (doc_id) WHERE page_path IS NOT NULL), bl AS (SELECT doc_id, {_path('page_path')} AS path, b, i FROM (SELECT doc_id, page_path, unnest(bs) AS b, unnest(generate_series(1, len(bs))) AS i FROM (SELECT doc_id, page_path, {_filled(r"regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n{2,}')")} AS bs FROM documents WHERE text IS NOT NULL AND page_path IS NOT NULL))),
wi AS (SELECT doc_id, path, i, CASE WHEN length(b) <= {E.SNIPPET} THEN [b] ELSE flatten(list_transform(string_split({_pack}, chr(30)), lambda w: {_windows('w')})) END AS ws FROM bl),
sn AS (SELECT doc_id, path, s, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS place FROM (SELECT doc_id, path, i, unnest(ws) AS s, unnest(generate_series(1, len(ws))) AS j FROM wi)),
sp AS (SELECT *, {_over('plain')} AS have FROM (SELECT *, {_plain('s')} AS plain FROM sn)), cp AS (SELECT *, {_over('claim')} AS want FROM (SELECT claim_id, path, {_plain('text')} AS claim FROM c) WHERE claim <> ''),
h AS (SELECT claim_id, doc_id, place, s, contains(plain, claim) AS holds, len(list_intersect(want, have)) AS n, len(want) AS w FROM cp JOIN sp USING (path)),
g AS (SELECT *, round(CASE WHEN holds THEN 1e0 WHEN w > 0 AND n >= least(3, w) AND n / w::DOUBLE >= {E.LEAST_SHARE}::DOUBLE THEN n / w::DOUBLE END, 6) AS score FROM h)
SELECT claim_id, doc_id, place::INT AS place, score, s AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY holds DESC, score DESC, doc_id, place) AS k FROM g WHERE score IS NOT NULL) WHERE k = 1""",
    "dedup_rewrites": rf"""WITH mg AS (SELECT canonical_slug AS canonical, p.slug AS slug, coalesce(p.content, '') AS text FROM (SELECT canonical_slug, unnest(merge_group) AS p FROM merge_requests WHERE canonical_slug IS NOT NULL) WHERE p.slug IS NOT NULL AND p.slug <> canonical_slug),
documents_of AS (SELECT row_number() OVER () AS k, * FROM mg), {_FRONT.replace('(SELECT * FROM documents WHERE text IS NOT NULL)', '(SELECT k AS doc_id, text FROM documents_of)')},
nm AS (SELECT canonical, slug AS name FROM mg UNION ALL SELECT canonical, unnest(entries) FROM fm JOIN documents_of ON k = doc_id WHERE lower(field) IN ('title', 'alias', 'aliases')),
ld AS (SELECT {_form('name')} AS form, min(canonical) AS canonical FROM nm GROUP BY 1 HAVING form <> ''),
lk AS (SELECT doc_id, target, count(*) AS times FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)), ' ') AS target FROM documents WHERE text IS NOT NULL) GROUP BY ALL)
SELECT doc_id, target, canonical, times FROM (SELECT *, {_form('target')} AS form FROM lk) JOIN ld USING (form) WHERE target <> canonical""",
    "graph_expansion": f"""WITH {_PLACES}, hi AS (SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '\\.md$', '') AS id, min(place) AS place FROM pl GROUP BY 1), rl AS ({graph.SQL['related_topk']})
SELECT other AS id, arg_min(relevance, (hi.place, rl.id)) AS relevance FROM rl JOIN hi ON hi.id = rl.id WHERE relevance >= 2 AND other NOT IN (SELECT id FROM hi WHERE id IS NOT NULL) GROUP BY other""",
}
