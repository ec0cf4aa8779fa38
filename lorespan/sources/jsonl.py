"""Append-only logs of one JSON object per line, read without losing a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The good lines, with ``fields`` (name -> type) and the whole object as VARIANT, and the bad ones with their file.

    A line that is no JSON object is bad; a missing or unfit field is null; blank lines are neither.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("raw")).where("trim(raw) <> ''")
    parsed = lines.withColumn("event", F.try_parse_json("raw"))
    is_object = F.col("event").isNotNull() & F.trim("raw").startswith("{")
    good = parsed.where(is_object).select("file", "event", *(F.try_variant_get("event", f"$.{name}", kind).alias(name) for name, kind in fields.items()))
    return good, parsed.where(~is_object | F.col("event").isNull()).select("file", "raw")


def append_log(events: DataFrame, path: str) -> None:
    """Events as one JSON object per line; null fields are left out."""
    events.write.mode("append").option("ignoreNullFields", True).json(path)


def export_csv(events: DataFrame, path: str, columns: list[str]) -> None:
    """Chosen columns as CSV with a header, quotes doubled."""
    events.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
