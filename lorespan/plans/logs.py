"""Queries on the event log, lint runs and schema findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.functions.links import reference_key
from lorespan.operators import governance as Q
from lorespan.operators import logs as L
from lorespan.plans.text import _KEY, sql_tokens
from lorespan.session import table

TODAY = "2026-07-01"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def lint(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lint_results").distinct()


def drift(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "schema_drift_findings").distinct()


def audit_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = lint(spark, folder).where(F.col("lint_type").isin("broken-link", "orphan") & (F.col("severity") == "warning") & F.contains(F.lower("page"), F.lit("index")))
    return rows.select("lint_id", "lint_type", "page", "run_at")


def audit_day_hist(spark: SparkSession, folder: str) -> DataFrame:
    return L.histogram(events(spark, folder), F.date_format("ts", "yyyy-MM-dd"), "day")


def audit_category_hist(spark: SparkSession, folder: str) -> DataFrame:
    return L.histogram(lint(spark, folder), F.coalesce("lint_type", F.lit("none")), "category", 6)


def actor_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return L.rollup_by(events(spark, folder), "user_id", "event_type", "ts", "event_id")


def target_rollup(spark: SparkSession, folder: str) -> DataFrame:
    targets = lint(spark, folder).select("lint_id", "lint_type", "severity", "run_at", F.explode("affected_pages").alias("link")).select("lint_id", "lint_type", "severity", "run_at", reference_key(F.col("link")).alias("target")).where("target is not null").distinct()
    return targets.groupBy("target").agg(F.count("*").alias("findings"), F.countDistinct("lint_type").alias("kinds"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.max("run_at").alias("last_at"))


def latest_event_per_actor(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


def last_events(spark: SparkSession, folder: str) -> DataFrame:
    """The last 20 events of every user, in order."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events(spark, folder).select("user_id", "event_id", place.alias("place")).where("place <= 20")


def egress_groups_7d(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of the seven days that end with the last event, by kind and bucket of value: allowed and blocked."""
    rows = events(spark, folder)
    end = rows.agg(F.max("ts").alias("end"))
    recent = rows.join(F.broadcast(end)).where(F.col("ts") > F.col("end") - F.expr("interval 7 days"))
    return recent.groupBy("event_type", F.floor(F.col("value") / 25).cast("long").alias("bucket")).agg(F.count_if(F.col("value") < 50).alias("allowed"), F.count_if(F.col("value") >= 50).alias("blocked"), F.max("ts").alias("last_seen"))


def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = L.parsed_lines(events(spark, folder).select("event_id", "event_type", "props"), "props")
    k = F.try_variant_get("parsed", "$.k", "long")
    return rows.groupBy("event_type").agg(F.count_if("bad").alias("bad"), F.count_if(k.isNotNull()).alias("with_k"), F.sum(k).alias("sum_k"))


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return L.sessions(events(spark, folder), "user_id", "ts", 30)


def arrival_delay(spark: SparkSession, folder: str) -> DataFrame:
    """By month of the run: findings, and those that came a day or more later."""
    late = F.col("received_at").cast("long") - F.col("run_at").cast("long") >= 86400
    return lint(spark, folder).groupBy(F.date_format("run_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("findings"), F.count_if(late).alias("late"))


def schema_drift_counts(spark: SparkSession, folder: str) -> DataFrame:
    return drift(spark, folder).groupBy("kind", "severity", F.date_format("detected_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("findings"), F.countDistinct("target_path").alias("pages"), F.count_if(F.col("candidate_target").isNotNull()).alias("repairable"))


def drift_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed targets that differ from the given one only in spelling."""
    rows = drift(spark, folder).select("finding_id", reference_key(F.col("relation_target")).alias("given"), reference_key(F.col("candidate_target")).alias("proposed"))
    return rows.where("given is not null and proposed is not null").withColumn("distance", F.levenshtein("given", "proposed")).where("distance <= 5")


def suggestion_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Findings sorted into kinds of work by their words."""
    words = F.lower(F.concat_ws(" ", "lint_type", "detail"))
    kind = F.when(words.rlike("contradict|conflict"), "contradiction").when(words.rlike("stale|old|supersed"), "staleness").when(words.rlike("broken|dangling|missing"), "links").when(words.rlike("orphan|outlink|isolated"), "structure").otherwise("other")
    return lint(spark, folder).groupBy(kind.alias("category"), "severity").agg(F.count("*").alias("findings"))


def lifecycle_score(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "retrieval_nodes").distinct().where("indexed_at is not null")
    tier = F.when(F.col("deleted_at").isNotNull(), "archived").otherwise(Q.lookup(Q.TIER_OF_TYPE, F.coalesce(F.lower(F.trim("page_type")), F.lit("")), "working"))
    sources = F.size(F.array_distinct(F.filter(F.coalesce("sources", F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull())))
    scored = Q.lifecycle(pages, tier, sources, F.coalesce(F.col("data_version"), F.lit(0)), F.col("indexed_at"), TODAY, F.col("deleted_at").isNotNull())
    return scored.select("row_id", "tier", "age_days", F.round("confidence", 6).alias("confidence"), "status", F.round("quality", 6).alias("quality"))


def merged_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of one page extracted several times, as one: the latest title and type, all tags."""
    rows = table(spark, folder, "entity_summaries").distinct().withColumn("tags", F.filter(F.coalesce("tags", F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull()))
    merged = Q.merged_claims(rows, "slug", F.struct("extracted_at", "summary_id"), ["title", "page_type"], ["tags"])
    return merged.select("slug", "title", "page_type", F.array_join("tags", "|").alias("tags"), "versions")


def conflicting_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of one slug against the one before: duplicate, reinforcement, update or new, by shared words of the description."""
    rows = table(spark, folder, "entity_summaries").distinct().where("slug is not null").select("slug", "summary_id", "extracted_at", F.array_distinct(T.query_tokens(F.coalesce("description", F.lit("")))).alias("words"))
    w = W.partitionBy("slug").orderBy("extracted_at", "summary_id")
    both = rows.withColumn("old", F.lag("words").over(w))
    share = F.size(F.array_intersect("words", "old")) / F.greatest(F.least(F.size("words"), F.size("old")), F.lit(1))
    kind = F.when(F.col("old").isNull(), "new").when(share >= 0.9, "duplicate").when(share >= 0.72, "reinforcement").when(share >= 0.45, "update").otherwise("uncertain")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("summaries"))


def duplicate_whitelist(spark: SparkSession, folder: str) -> DataFrame:
    """Proposed groups of duplicates, less the pairs that a run of low confidence had proposed alone: key, runs, best confidence."""
    rows = table(spark, folder, "duplicate_groups").distinct()
    key = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("slugs", lambda s: F.lower(F.trim(s))), lambda s: s.isNotNull() & (s != "")))), ",")
    keyed = rows.select("group_id", "confidence", key.alias("key")).where("key <> ''")
    groups = keyed.groupBy("key").agg(F.count("*").alias("runs"), F.count_if(F.col("confidence") == "high").alias("high"))
    declined = keyed.where("confidence = 'low'").select("key").distinct()
    return groups.join(declined, "key", "left_anti")


QUERIES = {f.__name__: f for f in (audit_filter, audit_day_hist, audit_category_hist, actor_rollup, target_rollup, latest_event_per_actor, last_events, egress_groups_7d, json_lines, user_sessions, arrival_delay, schema_drift_counts, drift_candidates, suggestion_categories, lifecycle_score, merged_summaries, conflicting_summaries, duplicate_whitelist)}

_LINT = "(SELECT DISTINCT * FROM lint_results)"
_DRIFT = "(SELECT DISTINCT * FROM schema_drift_findings)"
_HIST = lambda rows, key, name, tail="": f"""WITH c AS (SELECT {key} AS {name}, count(*) AS events FROM {rows} GROUP BY 1) SELECT {name}, events, round(events * 100e0 / (SELECT max(events) FROM c), 2) AS percent_of_top, round(events * 100e0 / (SELECT sum(events) FROM c), 2) AS percent_of_all FROM c {tail}"""
_CASE = lambda d, key: "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v}" for k, v in d.items())
_QB = T.QUERY_BREAK.replace("''", "''''")

SQL = {
    "audit_filter": f"SELECT lint_id, lint_type, page, run_at FROM {_LINT} WHERE lint_type IN ('broken-link', 'orphan') AND severity = 'warning' AND contains(lower(page), 'index')",
    "audit_day_hist": _HIST("events", "strftime(ts, '%Y-%m-%d')", "day"),
    "audit_category_hist": _HIST(_LINT, "coalesce(lint_type, 'none')", "category", "ORDER BY events DESC, category LIMIT 6"),
    "actor_rollup": """SELECT user_id, sum(n)::BIGINT AS events, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_kind, arg_max(event_type, last) AS last_kind, max(ts) AS last_at FROM (SELECT user_id, event_type, count(*) AS n, max((ts, event_id)) AS last, max(ts) AS ts FROM events GROUP BY ALL) GROUP BY user_id""",
    "target_rollup": f"SELECT target, count(*) AS findings, count(DISTINCT lint_type) AS kinds, count(*) FILTER (WHERE severity = 'warning') AS warnings, max(run_at) AS last_at FROM (SELECT DISTINCT lint_id, lint_type, severity, run_at, {_KEY.format('link')} AS target FROM (SELECT *, unnest(affected_pages) AS link FROM {_LINT})) WHERE target IS NOT NULL GROUP BY target",
    "latest_event_per_actor": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "last_events": "SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20",
    "egress_groups_7d": "SELECT event_type, floor(value / 25)::BIGINT AS bucket, count_if(value < 50)::BIGINT AS allowed, count_if(value >= 50)::BIGINT AS blocked, max(ts) AS last_seen FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL",
    "json_lines": "SELECT event_type, count_if(props IS NOT NULL AND NOT json_valid(props))::BIGINT AS bad, count(k) AS with_k, sum(k)::BIGINT AS sum_k FROM (SELECT *, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "user_sessions": """SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "arrival_delay": f"SELECT strftime(run_at, '%Y-%m') AS month, count(*) AS findings, count_if(floor(epoch(received_at)) - floor(epoch(run_at)) >= 86400)::BIGINT AS late FROM {_LINT} GROUP BY 1",
    "schema_drift_counts": f"SELECT kind, severity, strftime(detected_at, '%Y-%m') AS month, count(*) AS findings, count(DISTINCT target_path) AS pages, count(candidate_target) AS repairable FROM {_DRIFT} GROUP BY ALL",
    "drift_candidates": f"SELECT * FROM (SELECT *, levenshtein(given, proposed)::INT AS distance FROM (SELECT finding_id, {_KEY.format('relation_target')} AS given, {_KEY.format('candidate_target')} AS proposed FROM {_DRIFT}) WHERE given IS NOT NULL AND proposed IS NOT NULL) WHERE distance <= 5",
    "suggestion_categories": f"""SELECT CASE WHEN regexp_matches(w, 'contradict|conflict') THEN 'contradiction' WHEN regexp_matches(w, 'stale|old|supersed') THEN 'staleness' WHEN regexp_matches(w, 'broken|dangling|missing') THEN 'links' WHEN regexp_matches(w, 'orphan|outlink|isolated') THEN 'structure' ELSE 'other' END AS category, severity, count(*) AS findings
FROM (SELECT severity, lower(concat_ws(' ', lint_type, detail)) AS w FROM {_LINT}) GROUP BY ALL""",
    "lifecycle_score": f"""WITH r AS (SELECT DISTINCT row_id, deleted_at, page_type, sources, data_version, indexed_at FROM retrieval_nodes WHERE indexed_at IS NOT NULL),
t AS (SELECT *, CASE WHEN deleted_at IS NOT NULL THEN 'archived' ELSE coalesce({_CASE({k: "'" + v + "'" for k, v in Q.TIER_OF_TYPE.items()}, "lower(trim(page_type, ' '))")} END, 'working') END AS tier, len(list_distinct(list_filter(coalesce(sources, []), lambda x: x IS NOT NULL))) AS s, coalesce(data_version, 0) AS v, greatest(date_diff('day', indexed_at::DATE, DATE '{TODAY}'), 0) AS age FROM r),
c AS (SELECT *, CASE WHEN tier = 'procedural' THEN 365 WHEN tier = 'semantic' THEN 180 ELSE 45 END AS half FROM t), p AS (SELECT *, least(0.22e0, age / half::DOUBLE * 0.08e0) AS pen FROM c),
f AS (SELECT *, greatest(0e0, least(1e0, 0.45e0 + coalesce({_CASE({k: f'{v}e0' for k, v in Q.TIER_SCORE.items()}, 'tier')} END, 0e0) + CASE WHEN s > 0 THEN least(0.25e0, s * 0.07e0) ELSE -0.08e0 END + CASE WHEN v > 0 THEN least(0.18e0, ln(1e0 + v) * 0.055e0) ELSE 0e0 END
  - CASE WHEN pen > 0.005 THEN pen ELSE 0e0 END - CASE WHEN deleted_at IS NOT NULL THEN 0.35e0 ELSE 0e0 END)) AS conf FROM p),
z AS (SELECT *, CASE WHEN deleted_at IS NOT NULL OR age > half * 2 THEN 'stale' WHEN conf < 0.45 THEN 'needs-review' ELSE 'ok' END AS status FROM f)
SELECT row_id, tier, age::INT AS age_days, round(conf, 6) AS confidence, status, round(greatest(0e0, conf - CASE status WHEN 'stale' THEN 0.1e0 WHEN 'needs-review' THEN 0.06e0 ELSE 0e0 END), 6) AS quality FROM z""",
    "merged_summaries": """WITH r AS (SELECT DISTINCT * FROM entity_summaries) SELECT slug, arg_max(title, (extracted_at, summary_id)) FILTER (title IS NOT NULL) AS title, arg_max(page_type, (extracted_at, summary_id)) FILTER (page_type IS NOT NULL) AS page_type,
  array_to_string(list_sort(list_distinct(flatten(list(list_filter(coalesce(tags, []), lambda x: x IS NOT NULL))))), '|') AS tags, count(*) AS versions FROM r GROUP BY slug""",
    "conflicting_summaries": f"""WITH r AS (SELECT slug, summary_id, extracted_at, list_distinct({sql_tokens("coalesce(description, '')", _QB)}) AS w FROM (SELECT DISTINCT * FROM entity_summaries) WHERE slug IS NOT NULL),
b AS (SELECT *, lag(w) OVER (PARTITION BY slug ORDER BY extracted_at, summary_id) AS old FROM r), s AS (SELECT old, len(list_intersect(w, old)) / greatest(least(len(w), len(old)), 1)::DOUBLE AS share FROM b)
SELECT CASE WHEN old IS NULL THEN 'new' WHEN share >= 0.9 THEN 'duplicate' WHEN share >= 0.72 THEN 'reinforcement' WHEN share >= 0.45 THEN 'update' ELSE 'uncertain' END AS kind, count(*) AS summaries FROM s GROUP BY 1""",
    "duplicate_whitelist": """WITH k AS (SELECT group_id, confidence, array_to_string(list_sort(list_distinct(list_filter(list_transform(slugs, lambda s: lower(trim(s, ' '))), lambda s: s IS NOT NULL AND s <> ''))), ',') AS key FROM (SELECT DISTINCT * FROM duplicate_groups))
SELECT key, count(*) AS runs, count(*) FILTER (WHERE confidence = 'high') AS high FROM k WHERE key <> '' AND key NOT IN (SELECT key FROM k WHERE confidence = 'low' AND key IS NOT NULL) GROUP BY key""",
}
