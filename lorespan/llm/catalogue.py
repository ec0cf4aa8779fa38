"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.components import duplicate_classes
from lorespan.llm.encoding import encode_corpus
from lorespan.llm.leakage import leaked_documents, leaked_passages
from lorespan.llm import near_duplicates
from lorespan.llm.neighbours import found_pairs, nearest_vectors
from lorespan.llm.splitting import rebuilt_texts, split_corpus
from lorespan.llm.survivors import found_survivors, survivors
from lorespan.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda spark, folder: found_pairs(table(spark, folder, "chunk_vectors")),
    "p1_neighbours": lambda spark, folder: nearest_vectors(table(spark, folder, "chunk_vectors")).withColumn("score", F.round("score", 6)),
    "p2_found": lambda spark, folder: near_duplicates.found_pairs(table(spark, folder, "entity_summaries")),
    "p2_classes": lambda spark, folder: near_duplicates.similar_records(table(spark, folder, "entity_summaries"))[1],
    "p2_members": lambda spark, folder: near_duplicates.similar_records(table(spark, folder, "entity_summaries"))[0].toDF("summary_id", "class"),
    "p4_found": lambda spark, folder: found_survivors(table(spark, folder, "merge_requests"), table(spark, folder, "null_markers")),
    "p4_consistent": lambda spark, folder: survivors(
        table(spark, folder, "merge_requests"), table(spark, folder, "null_markers"), {"naming": ("title", "description"), "origin": ("tags", "sources"), "body": ("body",)}, [("body", "title"), ("body", "sources")]
    ),
    "p5_found": lambda spark, folder: duplicate_classes(table(spark, folder, "duplicate_groups")),
    "p6_ids": lambda spark, folder: encode_corpus(table(spark, folder, "documents", spread=True)),
    "p7_found": lambda spark, folder: leaked_documents(table(spark, folder, "documents", spread=True), table(spark, folder, "eval_items")),
    "p7_spans": lambda spark, folder: leaked_passages(table(spark, folder, "documents", spread=True), table(spark, folder, "eval_items")),
    "p8_pieces": lambda spark, folder: split_corpus(table(spark, folder, "documents", spread=True)),
    "p8_rebuilt": lambda spark, folder: rebuilt_texts(table(spark, folder, "documents"), split_corpus(table(spark, folder, "documents", spread=True))),
}

_NEAREST = """
WITH u AS (SELECT chunk_id, arg_max(embedding::DOUBLE[], upserted_at) AS e FROM chunk_vectors
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS place FROM s)"""

_WORDS = r"""
WITH r AS (SELECT DISTINCT summary_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, description, array_to_string(tags, ' '))), '[\p{L}\p{N}]+'))) AS w FROM entity_summaries),"""

SQL: dict[str, str] = {
    "p1_found": f"""{_NEAREST}
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE place <= 5 AND c >= 0.9""",
    "p1_neighbours": f"""{_NEAREST}
SELECT a AS id, b AS neighbour, round(c, 6) AS score, place::INT AS place FROM r WHERE place <= 5 AND c >= 0.9""",
    "p2_found": f"""{_WORDS}
e AS (SELECT summary_id, len(w) AS n, unnest(w) AS word FROM r WHERE len(w) >= 10)
SELECT a.summary_id AS summary_a, b.summary_id AS summary_b FROM e a JOIN e b ON a.word = b.word AND a.summary_id < b.summary_id
GROUP BY a.summary_id, b.summary_id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*))""",
    "p2_classes": f"""{_WORDS}
c AS (SELECT min(summary_id) AS id, w FROM r WHERE len(w) >= 10 GROUP BY w), e AS (SELECT id, len(w) AS n, unnest(w) AS word FROM c)
SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS similarity FROM e a JOIN e b ON a.word = b.word AND a.id < b.id
GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*))""",
    "p2_members": f"""{_WORDS}
SELECT summary_id, min(summary_id) OVER (PARTITION BY w) AS class FROM r WHERE len(w) >= 10""".replace("entity_summaries),", "entity_summaries)"),
    "p5_found": r"""
WITH RECURSIVE e AS (
  SELECT group_id, lower(regexp_replace(u.s, '^\s+|\s+$', '', 'g')) AS slug FROM duplicate_groups, unnest(slugs) AS u(s)),
k AS (SELECT DISTINCT group_id, slug FROM e WHERE slug IS NOT NULL AND slug <> ''),
l AS (SELECT DISTINCT x.slug AS a, y.slug AS b FROM k x JOIN k y USING (group_id) WHERE x.slug <> y.slug),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS slug, least(a, min(b)) AS group_slug FROM r GROUP BY a""",
    "p8_rebuilt": "SELECT doc_id, sha256(text) AS digest, true AS fit, true AS follow FROM documents WHERE text IS NOT NULL",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 12) AS n, array_to_string(list_slice(w, i, i + least(len(w), 12) - 1), ' ') AS gram
      FROM items, unnest(generate_series(1, len(w) - least(len(w), 12) + 1)) AS u(i) WHERE len(w) >= 8),
g AS (SELECT DISTINCT doc_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
      FROM d, (SELECT DISTINCT n FROM p) AS sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n)
SELECT DISTINCT doc_id, item_id FROM g JOIN p USING (n, gram)""",
    "p7_spans": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 12) AS n, array_to_string(list_slice(w, i, i + least(len(w), 12) - 1), ' ') AS gram
      FROM items, unnest(generate_series(1, len(w) - least(len(w), 12) + 1)) AS u(i) WHERE len(w) >= 8),
g AS (SELECT doc_id, n, i - 1 AS at_, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
      FROM d, (SELECT DISTINCT n FROM p) AS sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
o AS (SELECT DISTINCT doc_id, item_id, at_, n FROM g JOIN p USING (n, gram)),
m AS (SELECT *, CASE WHEN at_ <= lag(at_) OVER w + n THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY at_)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY at_) AS run FROM m)
SELECT doc_id, item_id, min(at_) AS first_word, max(at_) + max(n) - 1 AS last_word FROM r GROUP BY doc_id, item_id, run""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
