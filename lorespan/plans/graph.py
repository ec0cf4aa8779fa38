"""Queries on the link graph of the page registry."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.operators import graph as G
from lorespan.plans.text import _KEY
from lorespan.session import table, written


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return G.live_nodes(table(spark, folder, "retrieval_nodes"))


class _Graph:
    """What a query needs of the link graph, each part resolved once: written, as it is read several times."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.nodes = written(nodes(spark, folder), "nodes")

    @cached_property
    def links(self) -> DataFrame:
        return written(G.resolved_links(self.nodes), "links")

    @cached_property
    def edges(self) -> DataFrame:
        return written(G.directed_edges(G.resolved_links(self.nodes)), "edges")

    @cached_property
    def pairs(self) -> DataFrame:
        return G.undirected_edges(self.edges)

    @cached_property
    def relevance(self) -> DataFrame:
        """Linked pairs with their relevance as weight."""
        found = G.relevance(self.nodes, self.edges)
        return written(found.select("a", "b", "direct", "shared_sources", F.round("adamic_adar", 6).alias("adamic_adar"), F.round("relevance", 6).alias("relevance")), "relevance")

    @property
    def members(self) -> DataFrame:
        """Communities by directory."""
        return self.nodes.select("id", "type", F.concat_ws("/", "project_id", F.coalesce(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.lit(""))).alias("community"))


def link_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return _Graph(spark, folder).links.groupBy("source", "key", "target").agg(F.count("*").alias("times"))


def link_degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(_Graph(spark, folder).edges)


def undirected_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _Graph(spark, folder).pairs


def adamic_adar(spark: SparkSession, folder: str) -> DataFrame:
    return G.adamic_adar(written(_Graph(spark, folder).pairs, "pairs")).withColumn("adamic_adar", F.round("adamic_adar", 6))


def relevance_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _Graph(spark, folder).relevance


def related_topk(spark: SparkSession, folder: str) -> DataFrame:
    g = _Graph(spark, folder)
    return G.related(g.nodes, g.edges, 3).withColumn("relevance", F.round("relevance", 6))


def two_hop_decay(spark: SparkSession, folder: str) -> DataFrame:
    """What is reached from the pages whose title holds "index", by links weighted with a twelfth of their relevance."""
    g = _Graph(spark, folder)
    seeds = g.nodes.where(F.contains(F.lower("title"), F.lit("index"))).select("id", F.lit(1.0).alias("score"))
    return G.traverse(seeds, g.relevance.select("a", "b", (F.col("relevance") / 12).alias("weight"))).select("id", F.round("score", 6).alias("score"), "hops")


def graph_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose ends are both visible: of no hidden type, not structural, with at most 40 links."""
    g = _Graph(spark, folder)
    degree = G.degrees(g.edges)
    seen = written(g.nodes.where(~F.col("type").isin("query", "other") & ~F.col("id").isin(*G.STRUCTURAL)).join(degree.where("link_count <= 40"), "id", "left_semi").select("id"), "seen")
    kept = g.edges.join(seen.withColumnRenamed("id", "source"), "source", "left_semi").join(seen.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.select("source", "target", "times")


def surprising_edges(spark: SparkSession, folder: str) -> DataFrame:
    g = _Graph(spark, folder)
    return G.surprising(g.members, g.relevance.select("a", "b", F.col("relevance").alias("weight")), G.degrees(g.edges))


def community_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    g = _Graph(spark, folder)
    return G.community_stats(g.members.select("id", "community"), g.pairs).withColumn("cohesion", F.round("cohesion", 6))


def knowledge_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Isolated pages, sparse communities and bridges between communities."""
    g = _Graph(spark, folder)
    members, pairs = g.members.select("id", "community"), written(g.pairs, "pairs")
    alone = members.where(~F.col("id").isin(*G.STRUCTURAL)).join(G.degrees(g.edges), "id", "left").where("coalesce(link_count, 0) <= 1").select(F.lit("isolated").alias("gap"), "id")
    cohesion = G.community_stats(members, pairs).withColumn("cohesion", F.round("cohesion", 6))
    sparse = cohesion.where("cohesion < 0.15 and nodes >= 3").select(F.lit("sparse").alias("gap"), F.col("community").alias("id"))
    bridge = G.bridges(members, pairs).select(F.lit("bridge").alias("gap"), "id")
    return alone.unionByName(sparse).unionByName(bridge)


def page_communities(spark: SparkSession, folder: str) -> DataFrame:
    g = _Graph(spark, folder)
    return G.communities(g.nodes, g.relevance.select("a", "b", F.col("relevance").alias("weight")))


def lint_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Structural lint: pages without incoming links (orphan), without outgoing ones, and with broken links."""
    g = _Graph(spark, folder)
    pages = g.nodes.where(~F.col("id").isin(*G.STRUCTURAL)).select("id")
    linked = g.links.where("target is not null").select(F.col("target").alias("id")).distinct()
    linking = g.links.select(F.col("source").alias("id")).distinct()
    orphan = pages.join(linked, "id", "left_anti").select("id", F.lit("orphan").alias("finding"), F.lit(None).cast("string").alias("detail"))
    silent = pages.join(linking, "id", "left_anti").select("id", F.lit("no-outlinks").alias("finding"), F.lit(None).cast("string").alias("detail"))
    broken = g.links.where("target is null").select(F.col("source").alias("id"), F.lit("broken-link").alias("finding"), F.col("key").alias("detail")).distinct()
    return orphan.unionByName(silent).unionByName(broken)


def missing_backlinks(spark: SparkSession, folder: str) -> DataFrame:
    """Links that the target's own list of incoming links lacks."""
    rows = table(spark, folder, "retrieval_nodes").where("deleted_at is null and node_id is not null")
    listed = rows.select(F.col("node_id").alias("target"), F.explode("in_links").alias("source")).where("source is not null").distinct()
    return _Graph(spark, folder).edges.select("source", "target").join(listed, ["source", "target"], "left_anti")


def page_fate(spark: SparkSession, folder: str) -> DataFrame:
    """For every source file: how many of its pages stay, because other sources remain, and how many go with it."""
    each = nodes(spark, folder).select("id", F.size(F.array_distinct(F.transform("sources", F.lower))).alias("n"), F.explode(F.array_distinct(F.transform("sources", F.lower))).alias("source"))
    return each.groupBy("source").agg(F.count_if(F.col("n") > 1).alias("keep"), F.count_if(F.col("n") == 1).alias("delete"))


def cascade_delete_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Live pages that link to keys of deleted pages which nothing replaces, and how many links a cascade would take away."""
    rows = table(spark, folder, "retrieval_nodes")
    gone = rows.where("deleted_at is not null and node_id is not null").select("project_id", F.col("node_id").alias("key")).distinct()
    g = _Graph(spark, folder)
    own = g.links.where("target is null").join(g.nodes.select(F.col("id").alias("source"), "project_id"), "source")
    return own.join(gone, ["project_id", "key"], "left_semi").groupBy("source").agg(F.count("*").alias("removed"))


def alias_union(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases of a page over all its lifetimes, each once in any case, spelled as first seen."""
    rows = table(spark, folder, "retrieval_nodes").where("node_id is not null").distinct()
    each = rows.select("node_id", "created_at", "row_id", F.posexplode("aliases").alias("place", "alias")).where("trim(alias) <> ''").select("node_id", F.lower(F.trim("alias")).alias("folded"), F.trim("alias").alias("alias"), F.struct("created_at", "row_id", "place").alias("at"))
    first = each.groupBy("node_id", "folded").agg(F.min_by("alias", "at").alias("alias"), F.min("at").alias("at"))
    return first.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("at", "alias")))["alias"].alias("all")).select("node_id", F.array_join("all", "|").alias("aliases"), F.size("all").alias("n"))


def version_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that changed between consecutive lifetimes of a page, with the values before and after."""
    from pyspark.sql import Window as W

    rows = table(spark, folder, "retrieval_nodes").where("node_id is not null").distinct()
    w = W.partitionBy("node_id").orderBy("created_at", "row_id")
    fields = ("title", "page_type", "page_path", "data_version", "sources", "out_links")
    rows = rows.withColumns({"data_version": F.col("data_version").cast("string"), "sources": F.array_join("sources", "|"), "out_links": F.array_join("out_links", "|")})
    both = rows.select("node_id", "row_id", *fields, *(F.lag(f).over(w).alias(f"old_{f}") for f in fields), F.row_number().over(w).alias("n")).where("n > 1")
    diffs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("before"), F.col(f).alias("after")) for f in fields))
    return both.select("node_id", "row_id", F.explode(F.filter(diffs, lambda d: ~d["before"].eqNullSafe(d["after"]))).alias("d")).select("node_id", "row_id", "d.*")


QUERIES = {f.__name__: f for f in (link_resolution, link_degree, undirected_edges, adamic_adar, relevance_pairs, related_topk, two_hop_decay, graph_filters, surprising_edges, community_cohesion, knowledge_gaps, page_communities, lint_findings, missing_backlinks, page_fate, cascade_delete_refs, alias_union, version_diff)}

_STRUCT = "('index', 'log', 'overview')"
_CLEAN = lambda c: f"list_distinct(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL AND trim(x, ' ') <> ''))"
_BASE = f"""last AS (SELECT node_id AS id, unnest(max_by({{'project_id': project_id, 'title': title, 'page_type': page_type, 'path': page_path, 'sources': sources, 'aliases': aliases, 'out_links': out_links}}, {{'c': created_at, 'r': row_id}})) FROM retrieval_nodes WHERE deleted_at IS NULL AND node_id IS NOT NULL GROUP BY node_id),
n AS (SELECT id, project_id, title, path, coalesce(nullif(lower(trim(page_type, ' ')), ''), 'other') AS type, {_CLEAN('sources')} AS sources, {_CLEAN('aliases')} AS aliases, out_links FROM last),
names AS (SELECT project_id, key, arg_min(id, (rank, id)) AS target FROM (SELECT project_id, id AS key, 0 AS rank, id FROM n UNION ALL SELECT project_id, {_KEY.format('al')}, 1, id FROM (SELECT *, unnest(aliases) AS al FROM n)) WHERE key IS NOT NULL GROUP BY ALL),
l AS (SELECT k.source, k.key, names.target FROM (SELECT id AS source, project_id, {_KEY.format('link')} AS key FROM (SELECT *, unnest(out_links) AS link FROM n)) k LEFT JOIN names ON names.project_id = k.project_id AND names.key = k.key WHERE k.key IS NOT NULL),
e AS (SELECT source, target, count(*) AS times FROM l WHERE target IS NOT NULL AND source <> target GROUP BY ALL),
u AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS directions, sum(times)::BIGINT AS links FROM e GROUP BY 1, 2),
w AS (SELECT a AS id, b AS other, directions FROM u UNION ALL SELECT b, a, directions FROM u), dg AS (SELECT id, sum(directions) AS d FROM w GROUP BY id),
deg AS (SELECT id, sum(o)::BIGINT AS out_count, sum(i)::BIGINT AS in_count, sum(o + i)::BIGINT AS link_count FROM (SELECT source AS id, times AS o, 0 AS i FROM e UNION ALL SELECT target, 0, times FROM e) GROUP BY id),
aa AS (SELECT u.a, u.b, count(*) AS common, sum(1e0 / ln(greatest(dg.d, 2)::DOUBLE)) AS aa FROM u JOIN w x ON x.id = u.a JOIN w y ON y.id = u.b AND y.other = x.other JOIN dg ON dg.id = x.other GROUP BY ALL),
aff AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {v}e0)" for a, row in G.AFFINITY.items() for b, v in row.items())}) t(ta, tb, v)),
rel AS (SELECT a, b, direct, shared_sources, round(x, 6) AS adamic_adar, round(3e0 * direct + 4e0 * shared_sources + 1.5e0 * x + v, 6) AS relevance FROM (SELECT u.a, u.b, directions AS direct, len(list_intersect(p.sources, q.sources))::INT AS shared_sources, coalesce(aa.aa, 0e0) AS x, coalesce(aff.v, 0.5e0) AS v
  FROM u JOIN n p ON p.id = u.a JOIN n q ON q.id = u.b LEFT JOIN aa ON aa.a = u.a AND aa.b = u.b LEFT JOIN aff ON aff.ta = p.type AND aff.tb = q.type)),
m AS (SELECT id, type, concat_ws('/', project_id, coalesce(regexp_extract(path, '([^/]+)/[^/]+$', 1), '')) AS community FROM n),
coh AS (SELECT s.community, nodes, coalesce(inner_links, 0) AS inner_links, round(coalesce(inner_links, 0) / greatest(nodes * (nodes - 1) / 2e0, 1e0), 6) AS cohesion FROM (SELECT community, count(*) AS nodes FROM m GROUP BY 1) s LEFT JOIN
  (SELECT p.community, count(*) AS inner_links FROM u JOIN m p ON p.id = u.a JOIN m q ON q.id = u.b WHERE p.community = q.community GROUP BY 1) i USING (community))"""
_ROWS = "(SELECT DISTINCT row_id, node_id, project_id, title, page_type, page_path, aliases, created_at FROM retrieval_nodes WHERE node_id IS NOT NULL)"
SQL = {
    "link_resolution": f"WITH {_BASE} SELECT source, key, target, count(*) AS times FROM l GROUP BY ALL",
    "link_degree": f"WITH {_BASE} SELECT * FROM deg",
    "undirected_edges": f"WITH {_BASE} SELECT * FROM u",
    "adamic_adar": f"WITH {_BASE} SELECT a, b, common, round(aa, 6) AS adamic_adar FROM aa",
    "relevance_pairs": f"WITH {_BASE} SELECT * FROM rel",
    "related_topk": f"""WITH {_BASE}, cn AS (SELECT x.id, y.id AS other, sum(1e0 / ln(greatest(dg.d, 2)::DOUBLE)) AS aa FROM w x JOIN w y ON x.other = y.other AND x.id <> y.id JOIN dg ON dg.id = x.other GROUP BY ALL),
ap AS (SELECT p.id, q.id AS other, round(3e0 * coalesce(w.directions, 0) + 4e0 * len(list_intersect(p.sources, q.sources)) + 1.5e0 * coalesce(cn.aa, 0e0) + coalesce(aff.v, 0.5e0), 6) AS relevance
  FROM n p JOIN n q ON coalesce(p.project_id, '') = coalesce(q.project_id, '') AND p.id <> q.id LEFT JOIN w ON w.id = p.id AND w.other = q.id LEFT JOIN cn ON cn.id = p.id AND cn.other = q.id LEFT JOIN aff ON aff.ta = p.type AND aff.tb = q.type)
SELECT id, other, relevance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY relevance DESC, other) AS place FROM ap) WHERE place <= 3""",
    "two_hop_decay": f"""WITH {_BASE}, v AS (SELECT a AS id, b AS other, relevance / 12 AS weight FROM rel UNION ALL SELECT b, a, relevance / 12 FROM rel), h0 AS (SELECT id, 1e0 AS score FROM n WHERE contains(lower(title), 'index')),
h1 AS (SELECT other AS id, max(score * weight * 0.55e0) AS score FROM h0 JOIN v USING (id) WHERE score * weight * 0.55e0 >= 0.05 GROUP BY other), h2 AS (SELECT other AS id, max(score * weight * {0.55**2!r}::DOUBLE) AS score FROM h1 JOIN v USING (id) WHERE score * weight * {0.55**2!r}::DOUBLE >= 0.05 GROUP BY other)
SELECT id, round(max(score), 6) AS score, arg_max(hops, (score, -hops))::INT AS hops FROM (SELECT *, 0 AS hops FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY id""",
    "graph_filters": f"WITH {_BASE}, s AS (SELECT id FROM n SEMI JOIN (SELECT id FROM deg WHERE link_count <= 40) d USING (id) WHERE type NOT IN ('query', 'other') AND id NOT IN {_STRUCT}) SELECT source, target, times FROM e WHERE source IN (SELECT id FROM s) AND target IN (SELECT id FROM s)",
    "surprising_edges": f"""WITH {_BASE}, k AS (SELECT m.*, coalesce(link_count, 0) AS c FROM m LEFT JOIN deg USING (id) WHERE id NOT IN {_STRUCT})
SELECT * FROM (SELECT a, b, (CASE WHEN p.community <> q.community THEN 3 ELSE 0 END + CASE WHEN p.type = q.type THEN 0 WHEN p.type || '-' || q.type IN {G.DISTANT!r} THEN 2 ELSE 1 END
  + CASE WHEN least(p.c, q.c) <= 2 AND greatest(p.c, q.c) >= (SELECT greatest(max(link_count), 1) FROM deg) * 0.5 THEN 2 ELSE 0 END + CASE WHEN relevance > 0 AND relevance < 2 THEN 1 ELSE 0 END)::INT AS score FROM rel JOIN k p ON p.id = a JOIN k q ON q.id = b) WHERE score >= 3""",
    "community_cohesion": f"WITH {_BASE} SELECT * FROM coh",
    "knowledge_gaps": f"""WITH {_BASE} SELECT 'isolated' AS gap, id FROM m LEFT JOIN deg USING (id) WHERE id NOT IN {_STRUCT} AND coalesce(link_count, 0) <= 1 UNION ALL SELECT 'sparse', community FROM coh WHERE cohesion < 0.15 AND nodes >= 3
UNION ALL SELECT 'bridge', id FROM (SELECT w.id, count(DISTINCT m.community) AS c FROM w JOIN m ON m.id = w.other GROUP BY w.id) WHERE c >= 3""",
    "lint_findings": f"""WITH {_BASE} SELECT id, 'orphan' AS finding, NULL::VARCHAR AS detail FROM n WHERE id NOT IN {_STRUCT} AND id NOT IN (SELECT target FROM l WHERE target IS NOT NULL)
UNION ALL SELECT id, 'no-outlinks', NULL FROM n WHERE id NOT IN {_STRUCT} AND id NOT IN (SELECT source FROM l) UNION ALL SELECT DISTINCT source, 'broken-link', key FROM l WHERE target IS NULL""",
    "missing_backlinks": f"WITH {_BASE} SELECT source, target FROM e ANTI JOIN (SELECT node_id AS target, unnest(in_links) AS source FROM retrieval_nodes WHERE deleted_at IS NULL AND node_id IS NOT NULL) b USING (source, target)",
    "page_fate": f"WITH {_BASE} SELECT source, count_if(n > 1)::BIGINT AS keep, count_if(n = 1)::BIGINT AS delete FROM (SELECT id, len(s) AS n, unnest(s) AS source FROM (SELECT id, list_distinct(list_transform(sources, lambda x: lower(x))) AS s FROM n)) GROUP BY source",
    "cascade_delete_refs": f"WITH {_BASE} SELECT source, count(*) AS removed FROM l JOIN n ON n.id = l.source SEMI JOIN (SELECT project_id, node_id AS key FROM retrieval_nodes WHERE deleted_at IS NOT NULL AND node_id IS NOT NULL) g ON g.project_id = n.project_id AND g.key = l.key WHERE target IS NULL GROUP BY source",
    "alias_union": f"""SELECT node_id, string_agg(alias, '|' ORDER BY t) AS aliases, count(*)::INT AS n FROM (SELECT node_id, lower(trim(alias, ' ')) AS f, arg_min(trim(alias, ' '), (created_at, row_id, i)) AS alias, min((created_at, row_id, i)) AS t
  FROM (SELECT node_id, created_at, row_id, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS i FROM {_ROWS}) WHERE trim(alias, ' ') <> '' GROUP BY 1, 2) GROUP BY node_id""",
    "version_diff": f"""WITH v AS (SELECT node_id, row_id, created_at, unnest(['title', 'page_type', 'page_path', 'data_version', 'sources', 'out_links']) AS field, unnest([title, page_type, page_path, data_version::VARCHAR, array_to_string(sources, '|'), array_to_string(out_links, '|')]) AS after
  FROM (SELECT DISTINCT row_id, node_id, title, page_type, page_path, data_version, sources, out_links, created_at FROM retrieval_nodes WHERE node_id IS NOT NULL)),
b AS (SELECT *, lag(after) OVER w AS before, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY node_id, field ORDER BY created_at, row_id))
SELECT node_id, row_id, field, before, after FROM b WHERE n > 1 AND before IS DISTINCT FROM after""",
}
