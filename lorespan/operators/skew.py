"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of all rows; so there are at most as many hot keys as its inverse.
HOT_SHARE = 1 / 256

#: Rows of a key below which it is never hot.
HOT_ROWS = 20_000


def salted_sides(left: DataFrame, right: DataFrame, keys: list[str], rows: int, spread: list[str], salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt`` to be joined on ``keys`` and ``salt``: the left rows of a hot key are spread over ``salts``
    values by a hash of the columns ``spread``, the right rows of a hot key are repeated for each; other rows have salt 0.

    ``rows`` is the number of left rows.  The hot keys are broadcast: at most ``1 / HOT_SHARE`` rows, whatever the data.
    """
    hot = left.groupBy(*keys).count().where(F.col("count") > max(HOT_ROWS, int(rows * HOT_SHARE))).select(*keys, F.lit(True).alias("hot"))
    hot = F.broadcast(hot)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    wide = left.join(hot, keys, "left").withColumn("salt", salt).drop("hot")
    every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    deep = right.join(hot, keys, "left").withColumn("salt", F.explode(every)).drop("hot")
    return wide, deep
