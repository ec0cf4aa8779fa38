"""Scores of pages and claims by age, support and contradiction; conflicts between candidate claims; merges of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lifecycle tiers by page type, their part of the score, and their half-lives in days.
TIER_OF_TYPE = {"entity": "semantic", "concept": "semantic", "synthesis": "semantic", "source": "episodic", "query": "working", "comparison": "semantic", "overview": "semantic"}
TIER_SCORE = {"working": -0.08, "episodic": -0.02, "semantic": 0.06, "procedural": 0.1, "archived": -0.12}
HALF_LIFE = {"procedural": 365, "semantic": 180}
OTHER_HALF_LIFE = 45


def lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(default))


def lifecycle(rows: DataFrame, tier: Column, sources: Column, reinforcements: Column, confirmed: Column, today: str, superseded: Column | None = None, contradicted: Column | None = None) -> DataFrame:
    """``rows`` with ``tier``, ``age_days``, ``confidence``, ``status`` and ``quality``.

    Confidence starts at 0.45; tier, number of sources and of reinforcements raise or lower it, age lowers it by the tier's
    half-life, supersession and contradiction much; it is kept within 0 and 1.
    """
    no = F.lit(False)
    superseded, contradicted = superseded if superseded is not None else no, contradicted if contradicted is not None else no
    half = lookup(HALF_LIFE, tier, OTHER_HALF_LIFE)
    age = F.greatest(F.datediff(F.lit(today).cast("date"), confirmed.cast("date")), F.lit(0))
    penalty = F.least(F.lit(0.22), age / half * F.lit(0.08))
    score = (
        F.lit(0.45)
        + lookup(TIER_SCORE, tier, 0.0)
        + F.when(sources > 0, F.least(F.lit(0.25), sources * F.lit(0.07))).otherwise(F.lit(-0.08))
        + F.when(reinforcements > 0, F.least(F.lit(0.18), F.log1p(reinforcements.cast("double")) * F.lit(0.055))).otherwise(F.lit(0.0))
        - F.when(penalty > 0.005, penalty).otherwise(F.lit(0.0))
        - F.when(superseded, F.lit(0.35)).otherwise(F.lit(0.0))
        - F.when(contradicted, F.lit(0.25)).otherwise(F.lit(0.0))
    )
    with_score = rows.select("*", tier.alias("tier"), age.alias("age_days"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"), superseded.alias("_s"), contradicted.alias("_c"), half.alias("_h"))
    status = F.when(F.col("_c"), "contradicted").when(F.col("_s") | (F.col("age_days") > F.col("_h") * 2), "stale").when(F.col("confidence") < 0.45, "needs-review").otherwise("ok")
    lower = lookup({"contradicted": 0.18, "stale": 0.1, "needs-review": 0.06}, F.col("status"), 0.0)
    return with_score.withColumn("status", status).withColumn("quality", F.greatest(F.lit(0.0), F.col("confidence") - lower)).drop("_s", "_c", "_h")


def merged_claims(claims: DataFrame, id_col: str, version: Column, scalars: list[str], arrays: list[str]) -> DataFrame:
    """One row per claim: scalars of the latest version that has one, arrays as the union over all versions, sorted.

    Entries of arrays are made distinct before they meet in one row, so a claim of very many versions gathers no more than
    it has different entries.  Claims without an id are one.
    """
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), version)).alias(c) for c in scalars]
    merged = claims.groupBy(id_col).agg(*latest, F.count("*").alias("versions"))
    for c in arrays:
        entries = claims.select(F.col(id_col).alias("_of"), F.explode(c).alias("_entry")).where("_entry is not null").distinct()
        union = entries.groupBy("_of").agg(F.array_sort(F.collect_list("_entry")).alias(c))
        merged = merged.join(union, merged[id_col].eqNullSafe(union["_of"]), "left").drop("_of").withColumn(c, F.coalesce(c, F.array().cast(claims.schema[c].dataType)))
    return merged
