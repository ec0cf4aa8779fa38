"""Queries on what pages hold besides prose, and on candidates for unresolved names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions.links import reference_key
from lorespan.operators import graph as G
from lorespan.operators import pages as P
from lorespan.plans import graph, search
from lorespan.plans.text import _KEY
from lorespan.session import table, written

#: Characters of an index that a context holds.
INDEX_BUDGET = 400


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", "text")


def claim_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return P.claim_anchors(documents(spark, folder))


def anchored_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims by the number of documents and of different texts that anchor them: more than one text is a clash."""
    found = P.claim_anchors(documents(spark, folder))
    return found.groupBy("claim_id").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("claim").alias("texts"), F.min("doc_id").alias("first_doc"))


def review_items(spark: SparkSession, folder: str) -> DataFrame:
    joined = lambda c: F.array_join(c, "|").alias(c)
    return P.reviews(documents(spark, folder)).select("doc_id", "place", "kind", "title", joined("options"), joined("pages"), joined("searches"), "description")


def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What is embedded of each chunk's latest version."""
    rows = table(spark, folder, "chunk_vectors").where("chunk_id is not null")
    latest = rows.groupBy("chunk_id").agg(F.max_by(F.struct("page_id", "heading_path", "chunk_text"), F.struct("upserted_at", "chunk_text")).alias("c")).select("chunk_id", "c.*")
    return P.embedding_texts(latest, graph.nodes(spark, folder).select(F.col("id").alias("page_id"), "title"))


def index_trim(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read as an index and cut to a budget, with the lines that bear on the query."""
    return documents(spark, folder).where(F.length("text") > INDEX_BUDGET).select("doc_id", P.trimmed_index(F.col("text"), search.WORDS, INDEX_BUDGET).alias("kept")).where("kept <> ''")


def search_streams(spark: SparkSession, folder: str) -> DataFrame:
    """For the log of a search: how many of its first ten results each stream found."""
    found = written(search.rrf_search(spark, folder), "results").orderBy(F.desc("score"), "doc_id").limit(10)
    return found.agg(*(F.count(f"{name}_place").alias(name) for name in ("lexical", "bm25", "vector", "graph")), F.count("*").alias("results"))


def target_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of schema findings that lead to no page, with the first page whose key holds the name or is held by it."""
    keys = written(G.key_table(graph.nodes(spark, folder)), "keys")
    rows = table(spark, folder, "schema_drift_findings").select("finding_id", "project_id", reference_key(F.col("relation_target")).alias("name")).where("name is not null").distinct()
    lost = written(rows.join(keys.select("project_id", F.col("key").alias("name")).hint("shuffle_hash"), ["project_id", "name"], "left_anti"), "lost")
    found = P.name_candidates(lost.select("project_id", "name").distinct(), keys)
    return lost.join(found, ["project_id", "name"], "left").groupBy("finding_id", "name").agg(F.min("candidate").alias("candidate"))


QUERIES = {f.__name__: f for f in (claim_anchors, anchored_claims, review_items, embedding_texts, index_trim, search_streams, target_candidates)}

_white = "' ' || chr(9) || chr(13) || chr(10)"
_ANCHORS = rf"""al AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS ls FROM documents WHERE text IS NOT NULL),
az AS (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS line FROM al),
an AS (SELECT doc_id, ls, line, regexp_extract(ls[line], '{P.ANCHOR}', 1) AS claim_id FROM az),
an2 AS (SELECT doc_id, line::INT AS line, claim_id, coalesce(list_filter(list_transform(ls[line + 1:], lambda x: trim(regexp_replace(x, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+', ''), ' ' || chr(9))), lambda x: x <> '' AND NOT starts_with(x, '<!--'))[1], '') AS claim FROM an WHERE claim_id <> '')"""
_rv = lambda i: f"unnest(regexp_extract_all(text, '{P.REVIEW}', {i}))"
_line = lambda key: rf"regexp_extract(body, '(?:\A|\n){key}:[ \t]*([^\n]+)', 1)"
_split = lambda key, by: f"list_filter(list_transform(string_split({_line(key)}, '{by}'), lambda x: trim(x, {_white})), lambda x: x <> '')"
_trimmed = lambda c: f"nullif(trim(coalesce({c}, ''), {_white}), '')"

SQL = {
    "claim_anchors": f"WITH {_ANCHORS} SELECT * FROM an2",
    "anchored_claims": f"WITH {_ANCHORS} SELECT claim_id, count(DISTINCT doc_id) AS docs, count(DISTINCT claim) AS texts, min(doc_id) AS first_doc FROM an2 GROUP BY claim_id",
    "review_items": rf"""WITH r AS (SELECT doc_id, {_rv(1)} AS k, {_rv(2)} AS title, {_rv(3)} AS body, unnest(generate_series(0, len(regexp_extract_all(text, '{P.REVIEW}')) - 1)) AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, place::INT AS place, CASE WHEN lower(k) IN {P.REVIEW_KINDS!r} THEN lower(k) ELSE 'confirm' END AS kind, trim(title, {_white}) AS title, coalesce(nullif(array_to_string({_split('OPTIONS', '|')}, '|'), ''), 'Approve|Skip') AS options,
  array_to_string({_split('PAGES', ',')}, '|') AS pages, array_to_string({_split('SEARCH', '|')}, '|') AS searches, trim(regexp_replace(body, '(?:\A|\n)(?:OPTIONS|PAGES|SEARCH):[^\n]*', '', 'g'), {_white}) AS description FROM r""",
    "embedding_texts": f"""WITH {graph._BASE}, lc AS (SELECT chunk_id, unnest(max_by({{'page_id': page_id, 'heading_path': heading_path, 'chunk_text': chunk_text}}, {{'u': upserted_at, 't': chunk_text}})) FROM chunk_vectors WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
SELECT chunk_id, concat_ws(chr(10) || chr(10), {_trimmed('n_title')}, {_trimmed('heading_path')}, {_trimmed('chunk_text')}) AS content FROM lc LEFT JOIN (SELECT node_id AS page_id, unnest(max_by({{'n_title': title}}, {{'c': created_at, 'r': row_id}})) FROM retrieval_nodes WHERE deleted_at IS NULL AND node_id IS NOT NULL GROUP BY node_id) t USING (page_id)""",
    "index_trim": f"""SELECT * FROM (SELECT doc_id, regexp_replace(list_reduce([''] || list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '##') OR {' OR '.join(f"contains(lower(x), '{w}')" for w in search.WORDS)}), lambda done, x: CASE WHEN length(done) + length(x) + 1 <= {INDEX_BUDGET} THEN done || x || chr(10) ELSE done END), '\\n\\z', '') AS kept
  FROM documents WHERE length(text) > {INDEX_BUDGET}) WHERE kept <> ''""",
    "search_streams": f"SELECT count(lexical_place) AS lexical, count(bm25_place) AS bm25, count(vector_place) AS vector, count(graph_place) AS graph, count(*) AS results FROM (SELECT * FROM ({search.SQL['rrf_search']}) ORDER BY score DESC, doc_id LIMIT 10)",
    "target_candidates": f"""WITH {graph._BASE}, f AS (SELECT DISTINCT finding_id, project_id, {_KEY.format('relation_target')} AS name FROM schema_drift_findings), lost AS (SELECT * FROM f ANTI JOIN (SELECT project_id, key AS name FROM names) x USING (project_id, name) WHERE name IS NOT NULL)
SELECT finding_id, lost.name, min(target) AS candidate FROM lost LEFT JOIN names ON names.project_id = lost.project_id AND (contains(key, lost.name) OR contains(lost.name, key)) GROUP BY finding_id, lost.name""",
}
