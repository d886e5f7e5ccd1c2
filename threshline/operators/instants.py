"""Times of the review tables as instants, with the zone and date order of their project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshline.functions.timestamps import with_instant

#: A lookup of so many projects is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST = 100_000
#: source, key, project, text.
TIME_FIELDS = (
    ("object_attributes", "delivery_id", "project_id", "created_at"),
    ("merge_request", "mr_row", "target_project_id", "updated_at"),
    ("issue", "issue_row", "project_id", "created_at"),
)


def project_zones(projects: DataFrame) -> DataFrame:
    """(_project, _zone, _order) with one row a project, broadcast only when a count shows that it is small."""
    zones = projects.where("id IS NOT NULL").groupBy(F.col("id").alias("_project")).agg(F.min_by("time_zone", F.coalesce("time_zone", F.lit("~"))).alias("_zone"), F.min("date_order").alias("_order"))
    return F.broadcast(zones) if projects.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else zones


def instants(tables: dict[str, DataFrame], projects: DataFrame) -> DataFrame:
    """(src, row_key, utc_us): every row of the three tables whose time field names an instant; repeated rows repeat."""
    zones = project_zones(projects)
    parts = []
    for source, key, project, text in TIME_FIELDS:
        rows = tables[source].select(F.lit(source).alias("src"), F.col(key).alias("row_key"), F.col(project).alias("_project"), F.col(text).alias("_text")).where("_text IS NOT NULL")
        parts.append(rows.join(zones, "_project", "left"))
    everything = parts[0].unionByName(parts[1]).unionByName(parts[2])
    timed = with_instant(everything, "_text", "utc_us", F.col("_zone"), F.col("_order"))
    return timed.where("utc_us IS NOT NULL").select("src", "row_key", "utc_us")
