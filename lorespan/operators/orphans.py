"""References to records that do not exist, direct and inherited (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.functions.links import reference_key
from lorespan.operators.skew import salted_sides
from lorespan.session import written


#: Rounds whose tables are read one by one before they are written as one.
TOGETHER = 8


@dataclass(frozen=True)
class Source:
    """A table that refers to pages: its rows' id, the column with one link or many, and the time a link speaks of."""

    name: str
    rows: DataFrame
    id_col: str
    link_col: str
    time_col: str


def page_sources(nodes: DataFrame, lint: DataFrame, drift: DataFrame) -> list[Source]:
    """The three tables that refer to pages of their project."""
    return [
        Source("retrieval_nodes", nodes, "row_id", "out_links", "indexed_at"),
        Source("lint_results", lint, "lint_id", "affected_pages", "run_at"),
        Source("schema_drift_findings", drift, "finding_id", "relation_target", "detected_at"),
    ]


def references(sources: list[Source]) -> DataFrame:
    """``ref_table``, ``ref_id``, ``project_id``, ``target_key``, ``at``: every reference once."""
    found = None
    for s in sources:
        link = s.rows[s.link_col]
        links = link if s.rows.schema[s.link_col].dataType.typeName() == "array" else F.array(link)
        rows = s.rows.select(F.lit(s.name).alias("ref_table"), s.rows[s.id_col].cast("long").alias("ref_id"), s.rows["project_id"], s.rows[s.time_col].alias("at"), F.explode(links).alias("link"))
        rows = rows.select("ref_table", "ref_id", "project_id", reference_key(F.col("link")).alias("target_key"), "at")
        found = rows if found is None else found.unionByName(rows)
    return found.where("target_key is not null").distinct()


def registry(nodes: DataFrame) -> DataFrame:
    """``project_id``, ``target_key``, ``row_id``, ``created_at``, ``deleted_at``: every key under which a page row can be named."""
    aliases = F.filter(F.transform("aliases", reference_key), lambda x: x.isNotNull())
    keys = F.array_distinct(F.concat(F.array("node_id"), F.coalesce(aliases, F.expr("cast(array() as array<string>)"))))
    rows = nodes.select("project_id", F.explode(keys).alias("target_key"), F.col("row_id").cast("long").alias("row_id"), "created_at", "deleted_at")
    return rows.where("target_key is not null").distinct()


def orphan_references(sources: list[Source], nodes: DataFrame, owner: str = "retrieval_nodes", most_rounds: int | None = None) -> DataFrame:
    """``ref_table``, ``ref_id``, ``target_key``, ``at``, ``kind`` and ``depth`` of every reference that hangs in the air.

    *direct* (depth 0): no page row of the project had that key, as its name or an alias, at that time.  *inherited* (depth
    n): the reference resolves, but to a page row that is orphaned itself; a row is orphaned if one of its references is
    direct, or leads to an orphaned row.  A record can have references of both kinds; each is reported.

    Method: a fixpoint down the foreign-key graph.  The direct orphans come from an anti-join; each round then semi-joins
    the edges between page rows with the rows orphaned in the round before, until none is new (``most_rounds`` may stop it
    earlier; 0 leaves the direct ones).  Each round's new rows are written to the shared folder.  Keys that hold a large share
    of all references are salted (:func:`lorespan.operators.skew.salted_sides`).

    Null links, empty keys and URLs are no references; null times or projects never resolve; of a null list nothing comes;
    empty tables give no rows; repeated rows count once; other columns aren't read.  A page row that is its own
    ancestor is orphaned only if some row of the circle is.
    """
    refs = written(references(sources), "references")
    pages = registry(nodes)
    keys = ["project_id", "target_key"]
    refs_, pages_ = salted_sides(refs, pages, keys, refs.count(), ["ref_table", "ref_id"])
    refs_, pages_ = refs_.alias("r"), pages_.alias("p")
    alive = (F.col("p.created_at") <= F.col("r.at")) & (F.col("p.deleted_at").isNull() | (F.col("r.at") < F.col("p.deleted_at")))
    same = [F.col(f"r.{k}") == F.col(f"p.{k}") for k in (*keys, "salt")]
    # One outer join gives both: the page rows that a reference resolves to, and null for those that don't.
    resolved = written(refs_.join(pages_, [*same, alive], "left").select("r.ref_table", "r.ref_id", "r.target_key", "r.at", "p.row_id"), "resolved")
    direct = resolved.where("row_id is null").drop("row_id")
    found = direct.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})
    if most_rounds == 0:
        return found
    edges = resolved.where(F.col("row_id").isNotNull())
    own = edges.where(F.col("ref_table") == owner).select(F.col("ref_id").alias("child"), "row_id")
    orphaned = new = written(direct.where(F.col("ref_table") == owner).select(F.col("ref_id").alias("row_id")).distinct().withColumn("depth", F.lit(0)), "orphaned")
    depth = 0
    while (most_rounds is None or depth < most_rounds) and not new.isEmpty():
        depth += 1
        children = own.join(new.select("row_id"), "row_id", "left_semi").select(F.col("child").alias("row_id")).distinct()
        new = written(children.join(orphaned.select("row_id"), "row_id", "left_anti").withColumn("depth", F.lit(depth)), "orphaned")
        orphaned = orphaned.unionByName(new)
        if depth % TOGETHER == 0:
            orphaned = written(orphaned, "orphaned")
    inherited = edges.join(orphaned, "row_id").groupBy("ref_table", "ref_id", "target_key", "at").agg((F.min("depth") + 1).alias("depth"))
    return found.unionByName(inherited.withColumn("kind", F.lit("inherited")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """``ref_table``, ``month`` (``yyyy-MM``), ``direct`` and ``inherited`` references, the ``records`` that have any, and the
    ``direct_records`` that have a direct one; the others hang by inheritance alone."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    # Distinct records without carrying them to the groups: first once per record, then summed.
    each = orphans.groupBy("ref_table", "ref_id", month).agg(F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "inherited").alias("inherited"))
    return each.groupBy("ref_table", "month").agg(F.sum("direct").alias("direct"), F.sum("inherited").alias("inherited"), F.count("*").alias("records"), F.count_if(F.col("direct") > 0).alias("direct_records"))
