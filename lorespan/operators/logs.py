"""Event logs: tolerant reading, histograms, roll-ups, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_lines(lines: DataFrame, raw: str) -> DataFrame:
    """``lines`` with ``parsed`` (VARIANT, null where the text is no JSON) and ``bad``; no line is lost."""
    parsed = F.try_parse_json(raw)
    return lines.select("*", parsed.alias("parsed")).withColumn("bad", F.col(raw).isNotNull() & F.col("parsed").isNull())


def histogram(events: DataFrame, key: Column, name: str, most: int | None = None) -> DataFrame:
    """``name``, ``events``, and its percentages of the largest group and of all; the ``most`` largest groups if given."""
    counted = events.groupBy(key.alias(name)).agg(F.count("*").alias("events"))
    whole = counted.agg(F.max("events").alias("top"), F.sum("events").alias("all"))  # one row
    shown = counted.orderBy(F.desc("events"), name).limit(most) if most else counted
    return shown.join(F.broadcast(whole)).select(name, "events", F.round(F.col("events") * 100.0 / F.col("top"), 2).alias("percent_of_top"), F.round(F.col("events") * 100.0 / F.col("all"), 2).alias("percent_of_all"))


def rollup_by(events: DataFrame, who: str, what: str, at: str, order: str) -> DataFrame:
    """Per ``who``: number of events, kinds with their counts as a sorted text, and the last kind and time.

    First counted per kind, so that what reaches one ``who`` is bounded by the kinds, however many events it has.
    """
    each = events.groupBy(who, what).agg(F.count("*").alias("n"), F.max(F.struct(at, order)).alias("last"))
    return each.groupBy(who).agg(
        F.sum("n").alias("events"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(what, "n"))), lambda x: F.concat_ws("=", x[what], x["n"])), ",").alias("by_kind"),
        F.max_by(what, "last").alias("last_kind"),
        F.max("last")[at].alias("last_at"),
    )


def sessions(events: DataFrame, who: str, at: str, gap_minutes: int) -> DataFrame:
    """Per ``who`` and session, a run of events with no gap of ``gap_minutes`` or more: ``began``, ``ended``, ``events``."""
    window = F.session_window(at, f"{gap_minutes} minutes")
    return events.groupBy(who, window).agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count("*").alias("events")).drop("session_window")
