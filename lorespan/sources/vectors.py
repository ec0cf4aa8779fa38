"""A table of chunk vectors in which a page's chunks are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(chunks: DataFrame, size: int) -> DataFrame:
    """``chunks``; reading a vector of another length, or an empty page id, is an error."""
    fits = (F.size("vector") == size) & (F.trim("page_id") != "")
    problem = F.raise_error(F.concat(F.lit("unfit chunk "), F.coalesce("chunk_id", F.lit("null"))))
    return chunks.withColumn("vector", F.when(fits, F.col("vector")).otherwise(problem))


def upserted(table: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """The table after an upsert: chunks of every page that ``chunks`` has are replaced by them; an empty upsert changes nothing."""
    new = checked(chunks, size)
    kept = table.join(chunks.select("page_id").distinct(), "page_id", "left_anti")
    return kept.unionByName(new)


def deleted(table: DataFrame, pages: DataFrame) -> DataFrame:
    """The table without the chunks of some pages; pages that it doesn't have change nothing."""
    return table.join(pages.select("page_id").distinct(), "page_id", "left_anti")
