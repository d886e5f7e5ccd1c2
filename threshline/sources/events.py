"""Comment events as nested JSON: schemas, decoding, landing folders, templates and settings."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only what is read; numbers are taken as text and cast, so that one odd field does not lose the record.
GITHUB_SCHEMA = "action STRING, issue STRUCT<number: STRING, pull_request: STRUCT<url: STRING>, user: STRING, labels: STRING>, comment STRUCT<id: STRING, body: STRING>, repository STRUCT<id: STRING>"
GITLAB_SCHEMA = "object_kind STRING, object_attributes STRUCT<id: STRING, note: STRING, noteable_type: STRING, noteable_id: STRING>, project STRUCT<id: STRING>, merge_request STRUCT<id: STRING, iid: STRING>"


def decoded(df: DataFrame, raw: str, schema: str, corrupt: str = "_corrupt") -> DataFrame:
    """``df`` with ``event``, the decoded text; a text that is not one JSON object has a null event.

    Null texts, too, have a null event; unknown keys are passed over, absent ones are null.
    """
    whole = F.from_json(F.col(raw), f"{schema}, {corrupt} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    parsed = df.withColumn("_event", whole)
    good = F.col(f"_event.{corrupt}").isNull() & F.regexp_like(F.col(raw), F.lit(r"\A[ \t\r\n]*\{"))
    return parsed.withColumn("event", F.when(good, F.col("_event"))).drop("_event")


def whole_events(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with ``event``, the whole text as a variant: every field of it can be read by its path without a schema.

    A text that is not one JSON object has a null event.
    """
    event = F.try_parse_json(raw)
    return df.withColumn("event", F.when(F.schema_of_variant(event).startswith("OBJECT"), event))


def land(events: DataFrame, folder: str) -> None:
    """Appends raw events (event_row, payload) to a landing folder, as JSON lines; what is there stays."""
    events.write.mode("append").json(folder)


def note_events(raw: DataFrame) -> DataFrame:
    """Notes of raw events of the kind that names its object (event_row, payload), one row an event that decodes.

    (delivery_id, id, note, noteable_type, noteable_id, project_id, iid); the event's row stands for its delivery.
    """
    rows = decoded(raw, "payload", GITLAB_SCHEMA).where("event IS NOT NULL")
    a = "event.object_attributes"
    number = lambda path, name: F.col(path).try_cast("bigint").alias(name)
    noteable = F.coalesce(F.col("event.merge_request.id"), F.col(f"{a}.noteable_id")).alias("noteable_id")
    return rows.select(F.col("event_row").alias("delivery_id"), number(f"{a}.id", "id"), f"{a}.note", f"{a}.noteable_type", noteable, number("event.project.id", "project_id"), number("event.merge_request.iid", "iid"))


def landing_stream(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines that land in a folder, as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, lang, template) of the files review.<lang>.md and organize.<lang>.md; other files are passed over."""
    files = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    kind, lang = (F.regexp_extract("name", r"\A(review|organize)\.(.*)\.md\z", k) for k in (1, 2))
    return files.select(kind.alias("kind"), lang.alias("lang"), F.col("value").alias("template")).where("kind <> ''")


def languages(found: DataFrame) -> DataFrame:
    """(lang) of the languages that have templates of both kinds."""
    return found.groupBy("lang").agg(F.count_distinct("kind").alias("n")).where("n = 2").select("lang")


def settings(path: str) -> dict:
    """A TOML file as a mapping on the driver; it never becomes a DataFrame, so secrets stay out of plans and logs."""
    with Path(path).open("rb") as file:
        return tomllib.load(file)
