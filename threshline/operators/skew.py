"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is split.
ROWS_PER_PART = 200_000
#: Most keys that are ever split, hence most rows broadcast.
MOST_SPLIT = 1_000


def parts_of(count: Column, rows_per_part: int = ROWS_PER_PART) -> Column:
    """Into how many parts a key of so many rows is split."""
    return F.ceil(count / F.lit(rows_per_part)).cast("int")


def join_by_frequency(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: Column, how: str = "inner", rows_per_part: int = ROWS_PER_PART, part: str | None = None) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per key and the key's number of rows in ``count``.

    The MOST_SPLIT most frequent keys above ``rows_per_part`` are broadcast (a fixed bound on rows: a top-n) with the
    number of their parts.  Their rows spread over the parts by ``spread``, and their row of ``keyed`` is repeated once a
    part.  All other keys have one part.  No row is dropped, whatever the bounds.  ``part`` names a column for the number of
    the part, by which and the key the result is partitioned.
    """
    heavy = keyed.where(F.col(count) > rows_per_part).orderBy(F.col(count).desc(), F.col(key)).limit(MOST_SPLIT).select(key, parts_of(F.col(count), rows_per_part).alias("_parts"))
    left = rows.join(F.broadcast(heavy), key, "left")
    left = left.withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"))).drop("_parts")
    right = keyed.join(F.broadcast(heavy), key, "left")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    joined = left.join(right, [key, "_part"], how)
    return joined.withColumnRenamed("_part", part) if part else joined.drop("_part")
