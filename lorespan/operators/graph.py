"""Link graph of pages: nodes, resolved links, relevance, traversal, communities, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.links import reference_key
from lorespan.session import discard, written

#: Weights of the four signals of relevance, and how well two page types go together (else 0.5).
DIRECT, OVERLAP, COMMON = 3.0, 4.0, 1.5
AFFINITY = {
    "entity": {"concept": 1.2, "entity": 0.8, "source": 1.0, "synthesis": 1.0, "query": 0.8},
    "concept": {"entity": 1.2, "concept": 0.8, "source": 1.0, "synthesis": 1.2, "query": 1.0},
    "source": {"entity": 1.0, "concept": 1.0, "source": 0.5, "query": 0.8, "synthesis": 1.0},
    "query": {"concept": 1.0, "entity": 0.8, "synthesis": 1.0, "source": 0.8, "query": 0.5},
    "synthesis": {"concept": 1.2, "entity": 1.0, "source": 1.0, "query": 1.0, "synthesis": 0.8},
}

#: What more pages than this have (a neighbour, a source file) isn't listed pair by pair.
HUB = 64

#: Decay and floor of a traversal by hops.
DECAY, FLOOR = 0.55, 0.05

#: Pairs of types that are far apart.
DISTANT = ("source-concept", "concept-source", "source-synthesis", "synthesis-source", "query-entity", "entity-query")

STRUCTURAL = ("index", "log", "overview")


def live_nodes(pages: DataFrame) -> DataFrame:
    """One row per page that is still there, its latest: ``id``, ``project_id``, ``title``, ``type``, ``path``, ``sources``, ``aliases``, ``out_links``."""
    rows = pages.where("deleted_at is null and node_id is not null")
    last = rows.groupBy("node_id").agg(F.max_by(F.struct("project_id", "title", "page_type", "page_path", "sources", "aliases", "out_links"), F.struct("created_at", "row_id")).alias("n"))
    kind = F.coalesce(F.nullif(F.lower(F.trim("n.page_type")), F.lit("")), F.lit("other"))
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda x: x.isNotNull() & (F.trim(x) != "")))
    return last.select(F.col("node_id").alias("id"), "n.project_id", "n.title", kind.alias("type"), F.col("n.page_path").alias("path"), clean(F.col("n.sources")).alias("sources"), clean(F.col("n.aliases")).alias("aliases"), "n.out_links")


def resolved_links(nodes: DataFrame) -> DataFrame:
    """``source``, ``key``, ``target`` of every link of every page, repeats included; ``target`` is null if nothing has that key.

    A key names the page of that id, else the first page (by id) with that alias, in the same project.
    """
    links = nodes.select(F.col("id").alias("source"), "project_id", F.explode("out_links").alias("link")).select("source", "project_id", reference_key(F.col("link")).alias("key")).where("key is not null")
    ids = nodes.select("project_id", F.col("id").alias("key"), F.struct(F.lit(0).alias("rank"), F.col("id").alias("id")).alias("to"))
    aliases = nodes.select("project_id", "id", F.explode("aliases").alias("alias")).select("project_id", reference_key(F.col("alias")).alias("key"), F.struct(F.lit(1).alias("rank"), F.col("id").alias("id")).alias("to"))
    names = ids.unionByName(aliases.where("key is not null")).groupBy("project_id", "key").agg(F.min("to")["id"].alias("target"))
    return links.join(names, ["project_id", "key"], "left").select("source", "key", "target")


def directed_edges(links: DataFrame) -> DataFrame:
    """``source``, ``target``, ``times``; links to oneself are dropped."""
    return links.where("target is not null and source <> target").groupBy("source", "target").agg(F.count("*").alias("times"))


def undirected_edges(edges: DataFrame) -> DataFrame:
    """``a < b``, with the number of directions and of links."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("directions"), F.sum("times").alias("links"))


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``out_count``, ``in_count``, ``link_count``: every link counts at both of its ends."""
    ends = edges.select(F.col("source").alias("id"), F.col("times").alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.col("times").alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_count"), F.sum("i").alias("in_count"), F.sum(F.col("o") + F.col("i")).alias("link_count"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))


def page_degrees(pairs: DataFrame) -> DataFrame:
    """``id``, ``neighbours``, ``degree``: a page's pages, and its outgoing and incoming ones together, so that a mutual link counts two."""
    ways = pairs.select(F.col("a").alias("id"), "directions").unionByName(pairs.select(F.col("b").alias("id"), "directions"))
    return ways.groupBy("id").agg(F.count("*").alias("neighbours"), F.sum("directions").alias("degree"))


def adamic_adar(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``, ``common``, ``adamic_adar`` of linked pairs: the sum of 1 / ln(degree) over neighbours of both.

    ``pairs`` has ``a``, ``b`` and the number of ``directions``.  Each pair asks the neighbours of its end of fewer, so a hub's
    neighbours are never paired with each other: the work is that of listing triangles, not the square of a degree.
    """
    ways = _both_ways(pairs)
    degree = page_degrees(pairs)
    da, db = degree.select(F.col("id").alias("a"), F.col("neighbours").alias("da")), degree.select(F.col("id").alias("b"), F.col("neighbours").alias("db"))
    asked = pairs.join(da, "a").join(db, "b")
    low = F.when((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    asked = asked.select("a", "b", low.alias("id"), F.when(low == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("far"))
    middle = asked.join(ways, "id").where("other <> far").select("a", "b", "far", F.col("other").alias("mid"))
    closed = middle.join(ways.select(F.col("id").alias("mid"), F.col("other").alias("far")), ["mid", "far"], "left_semi")
    weighted = closed.join(degree.select(F.col("id").alias("mid"), "degree"), "mid")
    return weighted.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(F.lit(1.0) / F.ln(F.greatest("degree", F.lit(2)).cast("double"))).alias("adamic_adar"))


def affinity(a: Column, b: Column) -> Column:
    table = F.create_map(*(F.lit(x) for one, row in AFFINITY.items() for other, value in row.items() for x in (f"{one}-{other}", value)))
    return F.coalesce(F.try_element_at(table, F.concat_ws("-", a, b)), F.lit(0.5))


def relevance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``a``, ``b``, ``direct``, ``shared_sources``, ``adamic_adar``, ``relevance`` of every linked pair."""
    pairs = written(undirected_edges(edges), "pairs")  # read five times below
    near = adamic_adar(pairs)
    ends = nodes.select("id", "type", "sources")
    both = pairs.join(ends.toDF("a", "ta", "sa"), "a").join(ends.toDF("b", "tb", "sb"), "b").join(near, ["a", "b"], "left")
    aa = F.coalesce("adamic_adar", F.lit(0.0))
    shared = F.size(F.array_intersect("sa", "sb"))
    score = F.lit(DIRECT) * F.col("directions") + F.lit(OVERLAP) * shared + F.lit(COMMON) * aa + affinity(F.col("ta"), F.col("tb"))
    return both.select("a", "b", F.col("directions").alias("direct"), shared.alias("shared_sources"), aa.alias("adamic_adar"), score.alias("relevance"))


def related(nodes: DataFrame, edges: DataFrame, k: int, hub: int = HUB) -> DataFrame:
    """``id``, ``other``, ``relevance``, ``place``: the ``k`` most relevant other pages of its project for every page, linked or not.

    Two pages score by the links between them, by what both have (a neighbour, a source file) and by their types.  Pairs with
    a link, or that both have something which at most ``hub`` pages have, are listed and scored in full.  All other pairs score
    by their hubs and types alone, so pages of the same hubs and type are one group: each group gets its ``k + 1`` best pages
    from the first ``k + 1`` pages, by id, of each group, which holds the ``k`` best of any member besides itself.  A pair
    of the first kind has at least this score, so the greater of the two is right.
    """
    pairs = written(undirected_edges(edges).select("a", "b", "directions"), "pairs")
    project = F.coalesce("project_id", F.lit("")).alias("project")
    kind = F.when(F.col("type").isin(*AFFINITY), F.col("type")).otherwise(F.lit("")).alias("type")
    own = written(nodes.select("id", project, kind, "sources"), "nodes")
    ways = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "directions").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "directions"))
    things = ways.select("id", "directions", F.struct(F.lit("page").alias("kind"), F.lit("").alias("project"), F.col("other").alias("name")).alias("thing"))
    named = own.select("id", "project", F.explode(F.array_distinct("sources")).alias("name"))
    things = things.unionByName(named.select("id", F.lit(0).cast("long").alias("directions"), F.struct(F.lit("source").alias("kind"), "project", "name").alias("thing")))
    held = things.groupBy("thing").agg(F.count("*").alias("n"), F.sum("directions").alias("degree")).where("n > 1")
    weight = F.when(F.col("thing.kind") == "source", F.lit(OVERLAP)).otherwise(F.lit(COMMON) / F.ln(F.greatest("degree", F.lit(2)).cast("double")))
    things = things.drop("directions")
    things = written(things.join(held.select("thing", "n", weight.alias("weight")), "thing"), "things")

    few = things.where(F.col("n") <= hub)
    both = few.select("thing", "weight", F.col("id").alias("a")).join(few.select("thing", F.col("id").alias("b")), "thing").where("a < b").select("a", "b", "weight")
    listed = both.unionByName(pairs.select("a", "b", (F.lit(DIRECT) * F.col("directions")).alias("weight"))).groupBy("a", "b").agg(F.sum("weight").alias("score"))
    hubs = things.where(F.col("n") > hub).groupBy("id").agg(F.array_sort(F.collect_set(F.struct("thing", "weight"))).alias("hubs"))
    pages = own.drop("sources").join(hubs, "id", "left").withColumn("hubs", F.coalesce("hubs", F.expr("cast(array() as array<struct<thing:struct<kind:string,project:string,name:string>,weight:double>>)")))
    pages = written(pages, "pages")
    ends = pages.select("id", "type", "hubs")
    of_hubs = F.aggregate(F.array_intersect("ha", "hb"), F.lit(0.0), lambda sum_, h: sum_ + h["weight"])
    scored = listed.join(ends.toDF("a", "ta", "ha"), "a").join(ends.toDF("b", "tb", "hb"), "b").select("a", "b", (F.col("score") + of_hubs + affinity(F.col("ta"), F.col("tb"))).alias("relevance"))
    ways = scored.select(F.col("a").alias("id"), F.col("b").alias("other"), "relevance").unionByName(scored.select(F.col("b").alias("id"), F.col("a").alias("other"), "relevance"))

    group = ["project", "type", "hubs"]
    groups = pages.groupBy(*group).agg(F.min("id").alias("group"))
    first = pages.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("id"))).where(F.col("place") <= k + 1).join(groups, group).select("group", "project", "type", F.col("id").alias("other"))
    floor = first.withColumn("place", F.row_number().over(W.partitionBy("project", "type").orderBy("other"))).where(F.col("place") <= k + 1).select("project", F.col("type").alias("to"), "other")
    one = groups.select("group", "type", F.explode("hubs").alias("h")).select("group", "type", "h.thing", "h.weight")
    near = one.join(one.select("thing", F.col("group").alias("with"), F.col("type").alias("to")), "thing").groupBy("group", "with", "type", "to").agg(F.sum("weight").alias("score"))
    near = near.join(first.select(F.col("group").alias("with"), "other"), "with").select("group", "other", (F.col("score") + affinity(F.col("type"), F.col("to"))).alias("relevance"))
    near = near.unionByName(groups.join(floor, "project").select("group", "other", affinity(F.col("type"), F.col("to")).alias("relevance")))
    order = [F.desc(F.round("relevance", 6)), "other"]
    near = near.groupBy("group", "other").agg(F.max("relevance").alias("relevance")).withColumn("place", F.row_number().over(W.partitionBy("group").orderBy(*order))).where(F.col("place") <= k + 1)
    far = pages.join(groups, group).select("id", "group").join(near, "group").where("id <> other").select("id", "other", "relevance")

    all_ = ways.unionByName(far).groupBy("id", "other").agg(F.max("relevance").alias("relevance"))
    return all_.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(*order))).where(F.col("place") <= k)


def traverse(seeds: DataFrame, pairs: DataFrame, hops: int = 2, decay: float = DECAY, floor: float = FLOOR) -> DataFrame:
    """``id``, ``score``, ``hops``: the best decayed score by which each page is reached from the seeds (``id``, ``score``).

    A hop multiplies the score by the pair's ``weight`` and the decay to the power of the hop; what falls below the floor goes no further.
    """
    ways = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    reached = front = seeds.select("id", "score", F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        passed = front.join(ways, "id").select(F.col("other").alias("id"), (F.col("score") * F.col("weight") * F.lit(decay**hop)).alias("score")).where(F.col("score") >= floor)
        front = passed.groupBy("id").agg(F.max("score").alias("score")).withColumn("hops", F.lit(hop))
        reached = reached.unionByName(front)
    return reached.groupBy("id").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"))).alias("best")).select("id", "best.score", (-F.col("best.h")).alias("hops"))


def surprising(nodes: DataFrame, pairs: DataFrame, degree: DataFrame) -> DataFrame:
    """``a``, ``b``, ``score`` of linked pairs that surprise (3 or more): other communities 3; distant types 2, other types 1;
    a page of at most two links with one of at least half the most 2; a weight below 2 is 1.

    ``nodes`` has ``id``, ``type``, ``community``; ``pairs`` a ``weight``.
    """
    most = degree.agg(F.greatest(F.max("link_count"), F.lit(1)).alias("most"))
    ends = nodes.where(~F.col("id").isin(*STRUCTURAL)).join(degree.select("id", "link_count"), "id", "left").select("id", "type", "community", F.coalesce("link_count", F.lit(0)).alias("n"))
    both = pairs.join(ends.toDF("a", "ta", "ca", "na"), "a").join(ends.toDF("b", "tb", "cb", "nb"), "b").join(F.broadcast(most))
    types = F.when(F.col("ta") == F.col("tb"), 0).when(F.concat_ws("-", "ta", "tb").isin(*DISTANT), 2).otherwise(1)
    hub = (F.least("na", "nb") <= 2) & (F.greatest("na", "nb") >= F.col("most") * 0.5)
    score = F.when(F.col("ca") != F.col("cb"), 3).otherwise(0) + types + F.when(hub, 2).otherwise(0) + F.when((F.col("weight") > 0) & (F.col("weight") < 2), 1).otherwise(0)
    return both.select("a", "b", score.alias("score")).where("score >= 3")


def community_stats(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``community``, ``nodes``, ``inner_links``, ``cohesion`` (inner pairs of all possible ones) of ``members`` (``id``, ``community``)."""
    sizes = members.groupBy("community").agg(F.count("*").alias("nodes"))
    inner = pairs.join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("inner_links"))
    possible = F.greatest(F.col("nodes") * (F.col("nodes") - 1) / F.lit(2.0), F.lit(1.0))
    return sizes.join(inner, "community", "left").select("community", "nodes", F.coalesce("inner_links", F.lit(0)).alias("inner_links"), (F.coalesce("inner_links", F.lit(0)) / possible).alias("cohesion"))


def bridges(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id``, ``communities``: pages whose neighbours are in three or more communities."""
    near = _both_ways(pairs).join(members.select(F.col("id").alias("other"), "community"), "other")
    return near.groupBy("id").agg(F.countDistinct("community").alias("communities")).where("communities >= 3")


def communities(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id``, ``community`` of every node: weighted label propagation; a page takes the label that most of its neighbours' weight has.

    Of equal labels the smallest wins; a page without links keeps its own.  ``pairs`` has ``a``, ``b``, ``weight``.  It ends
    when no page wants another label.  In each round half of the pages, chosen by a hash, may change.  Once that no longer
    lowers the number of pages that want to, only pages change that come first, by a hash, among their neighbours that
    want to: no two neighbours change at once, so each round raises the weight between equal labels, or makes labels
    smaller at the same weight, and the end is sure.
    """
    ways = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "weight"))
    ways = written(ways.withColumn("weight", F.round(F.col("weight") * 1e6).cast("long")), "ways")  # whole numbers, so that sums are the same in any order
    labels = ways.select("id").distinct().withColumn("community", F.col("id"))
    state, before, alone, turn = None, None, False, 0
    while True:
        votes = ways.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id", "community").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("votes")).alias("less"), "community"))["community"].alias("next"))
        last, state = state, written(labels.join(best, "id").withColumn("order", F.xxhash64("id", F.lit(turn))), "labels")
        if last is not None:
            discard(last)
        wants = state.where("next <> community")
        left = wants.count()
        if not left:
            return nodes.select("id").join(state, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
        alone = alone or (turn % 2 == 0 and before is not None and left >= before)
        before = left if turn % 2 == 0 else before
        if alone:
            mine, theirs = wants.select("id", F.struct("order", "id").alias("mine")), wants.select(F.col("id").alias("other"), F.struct("order", F.col("id")).alias("theirs"))
            late = ways.join(mine, "id").join(theirs, "other").where("mine > theirs").select("id").distinct().withColumn("late", F.lit(True))
            labels = state.join(late, "id", "left").select("id", F.when(F.col("late"), F.col("community")).otherwise(F.col("next")).alias("community"))
        else:
            moves = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
            labels = state.select("id", F.when(moves, F.col("next")).otherwise(F.col("community")).alias("community"))
        turn += 1


#: Base weights of typed links.
EDGE_WEIGHTS = {"related_to": 1.2, "uses": 1.4, "depends_on": 1.5, "contradicts": 1.1, "supersedes": 1.3, "supports": 1.35, "derived_from": 0.8, "mentions": 1.0}

#: Front-matter fields that state a typed link; the second is read from its other end.
EDGE_FIELDS = {"related": "related_to", "uses": "uses", "depends_on": "depends_on", "contradicts": "contradicts", "supports": "supports", "supersedes": "supersedes", "superseded_by": "supersedes"}


def key_table(nodes: DataFrame) -> DataFrame:
    """``project_id``, ``key``, ``id``: the page that each key names; ids come before aliases, then the smallest id."""
    ids = nodes.select("project_id", F.col("id").alias("key"), F.struct(F.lit(0).alias("rank"), F.col("id").alias("id")).alias("to"))
    aliases = nodes.select("project_id", "id", F.explode("aliases").alias("alias")).select("project_id", reference_key(F.col("alias")).alias("key"), F.struct(F.lit(1).alias("rank"), F.col("id").alias("id")).alias("to"))
    return ids.unionByName(aliases.where("key is not null")).groupBy("project_id", "key").agg(F.min("to")["id"].alias("id"))


def typed_edges(nodes: DataFrame, stated: DataFrame, confidence: float = 0.55) -> DataFrame:
    """``source``, ``target``, ``type``, ``explicit``, ``weight``, each once, none to itself.

    Links in texts are mentions, source files that name a page are origins, and ``stated`` (``project_id``, ``source``,
    ``field``, ``link``) has links of front-matter fields.  A weight is the type's base, 1.15 times it if stated, and 0.75
    plus half of the ends' confidence.
    """
    keys = key_table(nodes)
    mentions = nodes.select("project_id", F.col("id").alias("source"), F.lit("mentions").alias("type"), F.lit(False).alias("explicit"), F.lit(False).alias("turned"), F.explode("out_links").alias("link"))
    origins = nodes.select("project_id", F.col("id").alias("source"), F.lit("derived_from").alias("type"), F.lit(True).alias("explicit"), F.lit(False).alias("turned"), F.explode("sources").alias("link")).withColumn("link", F.regexp_replace("link", r"\.[A-Za-z0-9]+$", ""))
    kinds = F.create_map(*(F.lit(x) for pair in EDGE_FIELDS.items() for x in pair))
    fields = stated.select("project_id", "source", F.try_element_at(kinds, F.col("field")).alias("type"), F.lit(True).alias("explicit"), (F.col("field") == "superseded_by").alias("turned"), "link").where("type is not null")
    links = mentions.unionByName(origins).unionByName(fields).withColumn("key", reference_key(F.col("link"))).where("key is not null")
    found = links.join(keys.withColumnRenamed("id", "target"), ["project_id", "key"]).where("source <> target")
    ends = found.select(F.when(F.col("turned"), F.col("target")).otherwise(F.col("source")).alias("source"), F.when(F.col("turned"), F.col("source")).otherwise(F.col("target")).alias("target"), "type", "explicit").distinct()
    base = F.element_at(F.create_map(*(F.lit(x) for pair in EDGE_WEIGHTS.items() for x in pair)), F.col("type"))
    return ends.withColumn("weight", base * F.when(F.col("explicit"), F.lit(1.15)).otherwise(F.lit(1.0)) * F.lit(0.75 + 0.5 * confidence))


def seed_scores(nodes: DataFrame, query: str, words: list[str], confidence: float = 0.55) -> DataFrame:
    """``id``, ``score`` of pages whose id or title is, or holds, the query or its words; where a traversal starts."""
    name = query.strip().lower().replace(" ", "-")
    title = F.replace(F.lower(F.trim("title")), F.lit(" "), F.lit("-"))
    score = F.when(F.col("id") == name, 4.0).otherwise(0.0) + F.when(title == name, 4.0).when(F.contains(title, F.lit(name)), 2.0).otherwise(0.0)
    for w in words:
        score = score + F.when(F.contains("id", F.lit(w)), 1.5).otherwise(0.0) + F.when(F.contains(title, F.lit(w)), 1.5).otherwise(0.0)
    return nodes.where("title is not null").select("id", (score * F.lit(0.75 + 0.5 * confidence)).alias("score")).where("score > 0")
