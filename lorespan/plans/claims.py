"""Queries on claims, contracts and typed links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import governance as Q
from lorespan.operators import graph as G
from lorespan.plans.graph import _BASE, nodes
from lorespan.plans.text import _KEY, SQL as _TEXT_SQL
from lorespan.session import table, written

TODAY = "2026-07-01"
QUERY, WORDS = "index", ["index", "relay"]
TYPES = ("entity", "concept", "source", "query", "comparison", "synthesis", "overview")


def _stated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "schema_drift_findings").where("relation_target is not null")
    return rows.select("project_id", T.file_stem(F.col("target_path")).alias("source"), F.col("field_name").alias("field"), F.col("relation_target").alias("link")).where("source is not null")


def typed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.typed_edges(nodes(spark, folder), _stated(spark, folder)).withColumn("weight", F.round("weight", 6))


def ranked_pages(spark: SparkSession, folder: str, query: str, words: list[str]) -> DataFrame:
    """``id``, ``score``, ``hops`` of the 12 best pages by a walk of two hops along typed links from the five best seeds."""
    n = written(nodes(spark, folder), "nodes")
    seeds = G.seed_scores(n, query, words).orderBy(F.desc("score"), "id").limit(5)
    edges = G.typed_edges(n, _stated(spark, folder)).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").alias("weight"))
    return G.traverse(seeds, written(edges, "typed")).select("id", F.round("score", 6).alias("score"), "hops").orderBy(F.desc("score"), "id").limit(12)


def typed_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_pages(spark, folder, QUERY, WORDS)


def one_sided_supersessions(spark: SparkSession, folder: str) -> DataFrame:
    """Supersessions that only one of the two pages states."""
    rows = _stated(spark, folder).where(F.col("field").isin("supersedes", "superseded_by"))
    keys = G.key_table(nodes(spark, folder)).withColumnRenamed("id", "target")
    keyed = rows.withColumn("key", G.reference_key(F.col("link"))).join(keys, ["project_id", "key"]).select("source", "field", "target").distinct()
    mirror = keyed.select(F.col("target").alias("source"), F.when(F.col("field") == "supersedes", "superseded_by").otherwise("supersedes").alias("field"), F.col("source").alias("target"))
    return keyed.join(mirror, ["source", "field", "target"], "left_anti")


def contract_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Front matters against the contract: missing or unknown type, missing title, bad date, a list field that is no list."""
    block = T.front_block(F.col("text"))
    value = lambda key: F.trim(F.regexp_extract("block", rf"(?:\A|\n){key}:[ \t]*([^\r\n]*)", 1))
    has = lambda key: F.col("block").rlike(rf"(?:\A|\n){key}:")
    rows = table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", block.alias("block"))
    updated = F.regexp_replace(value("updated"), "[\"']", "")
    day = F.try_to_date(updated, "yyyy-MM-dd")
    findings = F.array(
        F.when(value("title") == "", "missing-title"), F.when(~has("type") | (value("type") == ""), "missing-type").when(~F.lower(value("type")).isin(*TYPES), "unknown-type"),
        F.when(has("updated") & (~updated.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | day.isNull()), "bad-date"),
        *(F.when((value(f) != "") & ~value(f).startswith("["), f"{f}-no-list") for f in ("tags", "sources")),
    )
    found = F.when(F.col("block") == "", F.array(F.lit("missing-frontmatter"))).otherwise(F.filter(findings, lambda x: x.isNotNull()))
    return rows.select("doc_id", F.explode(found).alias("finding"))


def crystallize_score(spark: SparkSession, folder: str) -> DataFrame:
    """Documents worth keeping as pages, by length, links, structure, and words of conclusion and decision; 0.55 and more."""
    t, low = F.col("text"), F.lower("text")
    links = F.size(T.wikilinks(t))
    score = (
        F.when(F.length(t) >= 300, 0.15).otherwise(0.0) + F.when(F.length(t) >= 900, 0.15).otherwise(0.0) + F.when(F.length(t) >= 1800, 0.1).otherwise(0.0)
        + F.when(links >= 3, 0.3).when(links == 2, 0.22).when(links == 1, 0.18).otherwise(0.0) + F.when(t.rlike(r"\n#{1,6} "), 0.1).otherwise(0.0)
        + F.when(low.rlike("(conclu|summary|therefore|结论|总结)"), 0.15).otherwise(0.0) + F.when(low.rlike("(decid|decision|should|must|决定)"), 0.15).otherwise(0.0) + F.when(t.rlike(r"\n[-*] "), 0.08).otherwise(0.0)
    )
    scored = table(spark, folder, "documents", spread=True).where("length(text) >= 120").select("doc_id", F.round(score, 4).alias("score"))
    return scored.where("score >= 0.55")


def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """Claims with the documents that state them in the same words, their confidence by support and age, and a status."""
    rows = table(spark, folder, "documents", spread=True).where("text is not null").select("doc_id", "updated_at", F.explode(T.sentences_with_signal(F.col("text"))).alias("claim"))
    claims = rows.groupBy(F.lower("claim").alias("claim")).agg(F.countDistinct("doc_id").alias("sources"), F.max("updated_at").alias("confirmed"))
    scored = Q.lifecycle(claims, F.lit("semantic"), F.col("sources"), F.col("sources") - 1, F.col("confirmed"), TODAY)
    return scored.select("claim", "sources", "age_days", F.round("confidence", 6).alias("confidence"), "status")


def staleness_badges(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by tier: how many are older than one half-life (a badge), and than two (a review)."""
    pages = table(spark, folder, "retrieval_nodes").distinct().where("deleted_at is null and indexed_at is not null")
    tier = Q.lookup(Q.TIER_OF_TYPE, F.coalesce(F.lower(F.trim("page_type")), F.lit("")), "working")
    age = F.datediff(F.lit(TODAY).cast("date"), F.col("indexed_at").cast("date"))
    half = Q.lookup(Q.HALF_LIFE, F.col("tier"), Q.OTHER_HALF_LIFE)
    return pages.select(tier.alias("tier"), age.alias("age")).groupBy("tier").agg(F.count("*").alias("pages"), F.count_if(F.col("age") > half).alias("badge"), F.count_if(F.col("age") > half * 2).alias("review"))


def search_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Earlier searches against what they should have found: whether the page of the query chunk itself is among the first 5."""
    hits = table(spark, folder, "chunk_search_results").distinct().where("score is not null and query_chunk_id is not null")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("query_chunk_id").orderBy(F.desc("score"), "chunk_id", "search_id"))
    ranked = hits.select("query_chunk_id", F.substring_index("query_chunk_id", "#", 1).alias("expected"), "page_id", place.alias("place"))
    each = ranked.groupBy("query_chunk_id").agg(F.min(F.when(F.col("page_id") == F.col("expected"), F.col("place"))).alias("at"), F.count("*").alias("hits"))
    result = F.when(F.col("at").isNull(), "missing").when(F.col("at") > 5, "below-top-5").otherwise("passed")
    return each.groupBy(result.alias("result")).agg(F.count("*").alias("searches"), F.sum("hits").alias("hits"))


def markdown_links(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with ``[[target|label]]`` as Markdown links, but for fenced blocks and spans of code, which stay as they are."""
    plain = T.outside_code(F.col("text"), T.markdown_links)
    return table(spark, folder, "documents", spread=True).where(F.contains("text", F.lit("[["))).select("doc_id", plain.alias("markdown"))


def findings_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Lint findings of each project as columns by severity."""
    rows = table(spark, folder, "lint_results").distinct().withColumn("severity", F.coalesce("severity", F.lit("none")))
    return rows.groupBy("project_id").pivot("severity", ["info", "warning", "none"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {f.__name__: f for f in (typed_edges, typed_ranks, one_sided_supersessions, contract_drift, crystallize_score, claim_support, staleness_badges, search_eval, markdown_links, findings_by_kind)}

_TIER = "coalesce(CASE " + " ".join(f"WHEN lower(trim(page_type, ' ')) = '{k}' THEN '{v}'" for k, v in Q.TIER_OF_TYPE.items()) + " END, 'working')"
_W = lambda d: "CASE type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in d.items()) + " END"
_FIELD = "CASE field " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.EDGE_FIELDS.items()) + " END"
_EDGES = f"""{_BASE}, st AS (SELECT project_id, regexp_replace(regexp_replace(target_path, '^.*/', ''), '\\.md$', '') AS source, field_name AS field, {_KEY.format('relation_target')} AS key FROM schema_drift_findings WHERE relation_target IS NOT NULL AND target_path IS NOT NULL),
lk AS (SELECT project_id, id AS source, 'mentions' AS type, false AS explicit, false AS turned, {_KEY.format('link')} AS key FROM (SELECT *, unnest(out_links) AS link FROM n)
  UNION ALL SELECT project_id, id, 'derived_from', true, false, {_KEY.format('link')} FROM (SELECT *, regexp_replace(unnest(sources), '\\.[A-Za-z0-9]+$', '') AS link FROM n) UNION ALL SELECT project_id, source, {_FIELD}, true, field = 'superseded_by', key FROM st WHERE {_FIELD} IS NOT NULL),
te AS (SELECT DISTINCT CASE WHEN turned THEN target ELSE source END AS source, CASE WHEN turned THEN source ELSE target END AS target, type, explicit FROM lk JOIN names USING (project_id, key) WHERE source <> target),
tw AS (SELECT *, round({_W(G.EDGE_WEIGHTS)} * CASE WHEN explicit THEN 1.15e0 ELSE 1e0 END * {0.75 + 0.5 * 0.55!r}::DOUBLE, 6) AS weight FROM te)"""


def _RANKS(query: str, words: list[str]) -> str:  # noqa: N802
    """tr: the best pages along typed links."""
    name = query.strip().lower().replace(" ", "-")
    each = " + ".join(f"CASE WHEN contains(id, '{w}') THEN 1.5e0 ELSE 0 END + CASE WHEN contains(t, '{w}') THEN 1.5e0 ELSE 0 END" for w in words)
    factor = f"{0.75 + 0.5 * 0.55!r}::DOUBLE"
    raw = f"{_W(G.EDGE_WEIGHTS)} * CASE WHEN explicit THEN 1.15e0 ELSE 1e0 END * {factor}"
    hop = lambda i, before: f"h{i} AS (SELECT o AS id, max(score * weight * {0.55**i!r}::DOUBLE) AS score FROM {before} JOIN tv USING (id) WHERE score * weight * {0.55**i!r}::DOUBLE >= 0.05 GROUP BY o)"
    return f"""{_EDGES}, tp AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max({raw}) AS weight FROM te GROUP BY 1, 2), tv AS (SELECT a AS id, b AS o, weight FROM tp UNION ALL SELECT b, a, weight FROM tp),
h0 AS (SELECT id, score FROM (SELECT id, (CASE WHEN id = '{name}' THEN 4e0 ELSE 0 END + CASE WHEN t = '{name}' THEN 4e0 WHEN contains(t, '{name}') THEN 2e0 ELSE 0 END + {each}) * {factor} AS score
  FROM (SELECT id, replace(lower(trim(title, ' ')), ' ', '-') AS t FROM n WHERE title IS NOT NULL)) WHERE score > 0 ORDER BY score DESC, id LIMIT 5), {hop(1, 'h0')}, {hop(2, 'h1')},
tr AS (SELECT id, round(max(score), 6) AS score, arg_max(hops, (score, -hops))::INT AS hops FROM (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY id ORDER BY score DESC, id LIMIT 12)"""


_val = lambda k: rf"trim(regexp_extract(block, '(?:\A|\n){k}:[ \t]*([^\r\n]*)', 1), ' ')"
_CL = _TEXT_SQL["claim_lines"]

SQL = {
    "typed_ranks": f"WITH {_RANKS(QUERY, WORDS)} SELECT * FROM tr",
    "typed_edges": f"WITH {_EDGES} SELECT source, target, type, explicit, weight FROM tw",
    "one_sided_supersessions": f"""WITH {_EDGES}, k AS (SELECT DISTINCT source, field, target FROM st JOIN names USING (project_id, key) WHERE field IN ('supersedes', 'superseded_by'))
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k m WHERE m.source = k.target AND m.target = k.source AND m.field = CASE k.field WHEN 'supersedes' THEN 'superseded_by' ELSE 'supersedes' END)""",
    "contract_drift": rf"""WITH b AS (SELECT doc_id, regexp_extract(text, '{T.FRONT}', 1) AS block FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, block, {_val('title')} AS title, {_val('type')} AS type, replace(replace({_val('updated')}, '"', ''), '''', '') AS updated, {_val('tags')} AS tags, {_val('sources')} AS sources, regexp_matches(block, '(?:\A|\n)updated:') AS hu FROM b WHERE block <> '')
SELECT doc_id, 'missing-frontmatter' AS finding FROM b WHERE block = '' UNION ALL SELECT doc_id, 'missing-title' FROM v WHERE title = '' UNION ALL SELECT doc_id, CASE WHEN type = '' THEN 'missing-type' ELSE 'unknown-type' END FROM v WHERE lower(type) NOT IN {TYPES!r}
UNION ALL SELECT doc_id, 'bad-date' FROM v WHERE hu AND (NOT regexp_matches(updated, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR try_cast(updated AS DATE) IS NULL)
UNION ALL SELECT doc_id, 'tags-no-list' FROM v WHERE tags <> '' AND tags NOT LIKE '[%' UNION ALL SELECT doc_id, 'sources-no-list' FROM v WHERE sources <> '' AND sources NOT LIKE '[%'""",
    "crystallize_score": r"""SELECT * FROM (SELECT doc_id, round(CASE WHEN length(text) >= 300 THEN 0.15e0 ELSE 0 END + CASE WHEN length(text) >= 900 THEN 0.15e0 ELSE 0 END + CASE WHEN length(text) >= 1800 THEN 0.1e0 ELSE 0 END + CASE WHEN k >= 3 THEN 0.3e0 WHEN k = 2 THEN 0.22e0 WHEN k = 1 THEN 0.18e0 ELSE 0 END
  + CASE WHEN regexp_matches(text, '\n#{1,6} ') THEN 0.1e0 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(conclu|summary|therefore|结论|总结)') THEN 0.15e0 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(decid|decision|should|must|决定)') THEN 0.15e0 ELSE 0 END + CASE WHEN regexp_matches(text, '\n[-*] ') THEN 0.08e0 ELSE 0 END, 4) AS score
  FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS k FROM documents WHERE length(text) >= 120)) WHERE score >= 0.55""",
    "claim_support": f"""WITH c AS (SELECT lower(l.claim) AS claim, count(DISTINCT doc_id) AS sources, max(updated_at) AS confirmed FROM ({_CL}) l JOIN documents USING (doc_id) GROUP BY 1),
p AS (SELECT *, greatest(date_diff('day', confirmed::DATE, DATE '{TODAY}'), 0)::INT AS age_days FROM c), q AS (SELECT *, least(0.22e0, age_days / 180e0 * 0.08e0) AS pen FROM p),
s AS (SELECT *, greatest(0e0, least(1e0, 0.45e0 + 0.06e0 + least(0.25e0, sources * 0.07e0) + CASE WHEN sources > 1 THEN least(0.18e0, ln(1e0 + (sources - 1)) * 0.055e0) ELSE 0 END - CASE WHEN pen > 0.005 THEN pen ELSE 0 END)) AS conf FROM q)
SELECT claim, sources, age_days, round(conf, 6) AS confidence, CASE WHEN age_days > 360 THEN 'stale' WHEN conf < 0.45 THEN 'needs-review' ELSE 'ok' END AS status FROM s""",
    "staleness_badges": f"""SELECT tier, count(*) AS pages, count(*) FILTER (WHERE age > half) AS badge, count(*) FILTER (WHERE age > half * 2) AS review FROM (SELECT *, CASE tier WHEN 'procedural' THEN 365 WHEN 'semantic' THEN 180 ELSE 45 END AS half FROM (
  SELECT {_TIER} AS tier, date_diff('day', indexed_at::DATE, DATE '{TODAY}') AS age FROM (SELECT DISTINCT row_id, page_type, indexed_at FROM retrieval_nodes WHERE deleted_at IS NULL AND indexed_at IS NOT NULL))) GROUP BY tier""",
    "search_eval": """SELECT CASE WHEN at_ IS NULL THEN 'missing' WHEN at_ > 5 THEN 'below-top-5' ELSE 'passed' END AS result, count(*) AS searches, sum(hits)::BIGINT AS hits FROM (SELECT query_chunk_id, min(CASE WHEN page_id = split_part(query_chunk_id, '#', 1) THEN place END) AS at_, count(*) AS hits FROM (
  SELECT *, row_number() OVER (PARTITION BY query_chunk_id ORDER BY score DESC, chunk_id, search_id) AS place FROM (SELECT DISTINCT * FROM chunk_search_results WHERE score IS NOT NULL AND query_chunk_id IS NOT NULL)) GROUP BY 1) GROUP BY 1""",
    "markdown_links": rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '{T.CODE_OR_TEXT}'), lambda x: CASE WHEN starts_with(x, '`') THEN x ELSE regexp_replace(regexp_replace(x, '{T.LABELLED}', '[\2](#\1)', 'g'), '{T.UNLABELLED}', '[\1](#\1)', 'g') END), '') AS markdown FROM documents WHERE contains(text, '[[')""",
    "findings_by_kind": """SELECT project_id, count(*) FILTER (WHERE s = 'info') AS info, count(*) FILTER (WHERE s = 'warning') AS warning, count(*) FILTER (WHERE s = 'none') AS none FROM (SELECT project_id, coalesce(severity, 'none') AS s FROM (SELECT DISTINCT * FROM lint_results)) GROUP BY project_id""",
}
