"""Consolidation of pairwise or listed matches into groups (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import discard, written

#: Rounds in which the clusters of one level grow: start times are cut to this many rounds.
ROUNDS = 6

#: Rate of the exponential shifts; a smaller one gives larger clusters, which need more rounds.
BETA = 0.3


def list_links(lists: DataFrame, list_col: str = "slugs") -> DataFrame:
    """Links ``a < b`` that hold each list together: its smallest entry with every other one.

    Entries are trimmed and lower-cased; null and blank ones are ignored, as are lists that are null or of one entry.
    """
    entry = lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    entries = F.array_distinct(F.filter(F.transform(lists[list_col], entry), lambda x: x.isNotNull() & (x != "")))
    own = lists.select(entries.alias("all")).where(F.size("all") >= 2)
    return own.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b").distinct()


def _grow(edges: DataFrame, level: int, rounds: int, beta: float) -> DataFrame:
    """``v``, ``center``: the clusters of one level.

    Every vertex draws an exponential shift and starts the later, the smaller it is; it joins the cluster that reaches it
    first, or starts its own.  Start times are cut to ``rounds``, so nothing arrives later.  Shifts are hashes of the
    vertex, so a lost task that runs again draws the same ones.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("to")))
    starts = both.select("v").distinct()
    # Every vertex also sends to itself, at no cost, so that a round is one join and one reduction.
    ways = both.withColumn("cost", F.lit(1)).unionByName(starts.select("v", F.col("v").alias("to"), F.lit(0).alias("cost")))
    uniform = (F.shiftrightunsigned(F.xxhash64("v", F.lit(level)), 11).cast("double") + 1) / F.lit(float(1 << 53))
    start = F.greatest(F.lit(0), F.lit(rounds) - F.floor(-F.log(uniform) / beta)).cast("int")
    # The order of arrivals: the time, then a hash of the center instead of the shift's fraction, then its name.
    state = starts.select("v", F.struct(start.alias("at"), F.xxhash64("v", F.lit(-level - 1)).alias("turn"), F.col("v").alias("center")).alias("first"))
    for now in range(rounds):
        # Who was reached, or started, just now can't be reached earlier any more, and sends once: each link carries two messages in all.
        sent = ways.join(state, "v").where((F.col("cost") == 0) | (F.col("first.at") == now))
        arrival = F.struct((F.col("first.at") + F.col("cost")).alias("at"), F.col("first.turn").alias("turn"), F.col("first.center").alias("center"))
        state = sent.select(F.col("to").alias("v"), arrival.alias("first")).groupBy("v").agg(F.min("first").alias("first"))
    return state.select("v", F.col("first.center").alias("center"))


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", rounds: int = ROUNDS, beta: float = BETA) -> DataFrame:
    """``member``, ``group_name`` for every member of a link: all that are linked directly or through others share the
    smallest member's name.

    Method: low-diameter decomposition.  Clusters grow for a few rounds from exponentially shifted start times
    (:func:`_grow`), contract to super-vertices, and the same goes on with the links between clusters until none is left;
    a level leaves a constant share of the links, so the levels are about the logarithm of the number of links, whatever the
    shapes (chains, stars).  Each level's assignment of its vertices is written to the shared folder; at the end they are
    composed from the last level, of fewest vertices, down to the members.  A level's links are deleted after the next one's.

    Links to oneself, repeated ones and those with a null end change nothing; an empty table gives no rows.  A member
    of very many links is no bottleneck: arrivals are reduced by a partial ``min`` before each shuffle, and the join
    that sends them has one row per vertex on its other side, so that adaptive execution splits the hot key.
    """
    ends = links.select(links[a].alias("a"), links[b].alias("b")).where("a is not null and b is not null and a <> b")
    edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        grown = written(_grow(edges, len(levels), rounds, beta), "clusters")
        levels.append(grown)
        left = grown.select(F.col("v").alias("a"), F.col("center").alias("ca"))
        right = grown.select(F.col("v").alias("b"), F.col("center").alias("cb"))
        between = edges.join(left, "a").join(right, "b").where("ca <> cb")
        next_ = written(between.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
        discard(edges)
        edges = next_
    if not levels:
        return ends.select(F.col("a").alias("member"), F.col("b").alias("group_name"))
    of = levels.pop()
    while levels:
        # A center without links to others is no vertex of the next level: it is complete.
        last = of.toDF("center", "last")
        of = levels.pop().join(last, "center", "left").select("v", F.coalesce("last", "center").alias("center"))
    of = written(of, "groups")
    return of.join(of.groupBy("center").agg(F.min("v").alias("group_name")), "center").select(F.col("v").alias("member"), "group_name")


def duplicate_classes(lists: DataFrame, list_col: str = "slugs") -> DataFrame:
    """``slug``, ``group_slug``: every slug that some list puts together with another one; see :func:`connected_groups`."""
    return connected_groups(list_links(lists, list_col)).toDF("slug", "group_slug")
