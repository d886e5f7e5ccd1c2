"""One copy of each message that was delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threshline.functions.timestamps import with_instant
from threshline.operators.skew import ROWS_PER_PART, join_by_frequency
from threshline.session import checkpointed


def labelled(df: DataFrame, key: str, row: str, updated: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(row, keep) of every row with an identifier.

    Identifiers are split by their aggregated frequency, which reads nothing but them.  Rows whose identifier occurs once
    pass directly.  Only rows of repeated groups get their time read and are ranked, each part of a large group by itself,
    then the first rows of its parts.  Both sides are united.
    """
    named = df.where(F.col(key).isNotNull())
    repeated = checkpointed(named.groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1"))
    narrow = named.select(F.col(key).alias("_id"), F.col(row).alias("_row"), F.col(updated).alias("_updated"))
    split = join_by_frequency(narrow, repeated, "_id", "_n", F.col("_row"), "left", rows_per_part, part="_part")
    single = split.where("_n IS NULL").select(F.col("_row").alias(row), F.lit(True).alias("keep"))
    timed = with_instant(split.where("_n IS NOT NULL"), "_updated", "_at")
    order = (F.col("_at").desc_nulls_last(), F.col("_row"))
    # The join has brought the parts together already, so this window needs no further shuffle.  The count follows from the
    # identifier; as a key of the window it lets the choice of split groups below go through to the join.
    first = timed.withColumn("_rank", F.row_number().over(Window.partitionBy("_id", "_part", "_n").orderBy(*order)))
    whole = F.col("_n") <= rows_per_part
    settled = first.where(whole | (F.col("_rank") > 1)).select(F.col("_row").alias(row), (F.col("_rank") == 1).alias("keep"))
    # One row a part of each split group is left.
    heads = first.where(~whole & (F.col("_rank") == 1)).withColumn("_rank", F.row_number().over(Window.partitionBy("_id").orderBy(*order)))
    return single.unionByName(settled).unionByName(heads.select(F.col("_row").alias(row), (F.col("_rank") == 1).alias("keep")))


def dropped_deliveries(df: DataFrame, key: str = "id", row: str = "delivery_id", updated: str = "updated_at", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(row): every row to be dropped.

    Kept of each identifier is the row with the latest instant in ``updated`` (null and unreadable ones are older than
    all), of equal ones the smallest row number.  Rows with a null identifier are never dropped.  An empty table gives an
    empty result; row numbers are unique.
    """
    return labelled(df, key, row, updated, rows_per_part).where("NOT keep").select(row)


def kept_deliveries(df: DataFrame, key: str = "id", row: str = "delivery_id", updated: str = "updated_at", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(row): singletons as they are, the first of each repeated group, and rows with a null identifier."""
    return labelled(df, key, row, updated, rows_per_part).where("keep").select(row).unionByName(df.where(F.col(key).isNull()).select(row))


def merged_deliveries(stored: DataFrame, new: DataFrame, key: str = "id", row: str = "delivery_id", updated: str = "updated_at", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(row): what is kept of a stored result and a new batch.

    The latest of all is the latest of the stored latest and the new ones, so the stored rows stand for all that came
    before: an identifier that the batch doesn't name occurs once and passes without its time being read.
    """
    columns = [key, row, updated]
    return kept_deliveries(stored.select(*columns).unionByName(new.select(*columns)), key, row, updated, rows_per_part)
