"""Streams over the event log and the inbox: day counts, the maintenance gate, and a queue that survives restarts."""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def day_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "2 days") -> DataFrame:
    """Events per day and kind; a day is final when the watermark, ``late`` behind the newest event, has passed its end."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), kind).agg(F.count("*").alias("events")).select(F.col("day.start").alias("day"), kind, "events")


def trailing_groups(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str = "1 day") -> DataFrame:
    """Groups of sliding windows of seven days, a new one every day."""
    return events.withWatermark(at, late).groupBy(F.window(at, "7 days", "1 day").alias("span"), kind).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("span.start").alias("began"), kind, "events", "value")


def gate(events: DataFrame, keys: list[str], at: str, most_events: int = 5, cooldown_hours: float = 24) -> DataFrame:
    """``keys``, ``at``, ``waiting`` of every opening of the gate that asks for maintenance, for each key by itself.

    An event opens it if at least ``most_events`` have come since maintenance was done, it included, and ``cooldown_hours`` have
    gone by since it opened last.  State per key is a count and a time, whatever the length of the log; a batch's events of
    one key are put in order in its task, so keys should be as fine as the rule allows.
    """
    rows = events.select(*keys, F.col(at).cast("timestamp").alias("at"))
    cooldown = pd.Timedelta(hours=cooldown_hours)

    def openings(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = state.get if state.exists else (0, None)
        found = []
        for now in pd.concat([f["at"] for f in frames]).sort_values():
            waiting += 1
            if waiting >= most_events and (last is None or now - pd.Timestamp(last) >= cooldown):
                last = now
                found.append((*key, now, waiting))
        state.update((waiting, last))
        if found:
            yield pd.DataFrame(found, columns=[*keys, "at", "waiting"]).astype({"waiting": "int64"})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.groupBy(*keys).applyInPandasWithState(openings, f"{kinds}, at timestamp, waiting long", "waiting long, last timestamp", "append", GroupStateTimeout.NoTimeout)


def run_queue(tasks: DataFrame, work: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Work through tasks as they arrive; each batch's results are written under its number, so that a batch that is run again after a
    crash replaces its own results and nothing else."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tasks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
