"""Streaming queries over the event log, run until the files that are there are worked off."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.session import shared_folder
from lorespan.streaming import jobs


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _worked_off(stream: DataFrame, name: str) -> DataFrame:
    """The stream's appended rows, written to the shared folder with its checkpoint."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(path=f"{path}/rows", format="parquet")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_day_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events per day and kind of the days that the watermark has closed."""
    return _worked_off(jobs.day_counts(_events(spark, folder)), "days").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events")


def stream_trailing_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding groups of seven days that the watermark has closed."""
    return _worked_off(jobs.trailing_groups(_events(spark, folder)), "spans").select(F.date_format("began", "yyyy-MM-dd").alias("began"), "event_type", "events", F.round("value", 2).alias("value"))


def stream_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Openings of the maintenance gate of each actor and kind of event."""
    return _worked_off(jobs.gate(_events(spark, folder), ["user_id", "event_type"], "ts"), "gate").withColumnRenamed("at", "opened_at")


QUERIES = {f.__name__: f for f in (stream_day_counts, stream_trailing_groups, stream_gate)}

SQL = {
    "stream_gate": """WITH RECURSIVE n AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_type, ts AS opened_at, i AS waiting FROM n WHERE i = 5
  UNION ALL SELECT user_id, event_type, opened_at, waiting FROM (SELECT n.user_id, n.event_type, n.ts AS opened_at, n.i AS waiting, row_number() OVER (PARTITION BY n.user_id, n.event_type ORDER BY n.i) AS k FROM r JOIN n ON n.user_id = r.user_id AND n.event_type = r.event_type AND n.i > r.waiting AND n.ts >= r.opened_at + INTERVAL 24 HOUR) WHERE k = 1)
SELECT user_id, event_type, opened_at, waiting FROM r""",
    "stream_day_counts": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY 1, 2""",
    "stream_trailing_groups": """SELECT strftime(b, '%Y-%m-%d') AS began, event_type, count(*) AS events, round(sum(value), 2) AS value FROM (SELECT *, unnest(list_transform(range(0, 7), lambda i: ts::DATE::TIMESTAMP - i * INTERVAL 1 DAY)) AS b FROM events)
WHERE b + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""",
}
