"""Queries of the review pipeline and the SQL each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshline.functions import text as X
from threshline.operators import reviews as R
from threshline.operators.models import complete_rows
from threshline.session import checkpoint_dir, checkpointed, remove, table, write_text
from threshline.sources.events import GITHUB_SCHEMA, decoded, land, landing_stream, languages, note_events, settings, templates, whole_events
from threshline.streaming.sinks import KeyedSink, comment_stream, start

SETTINGS = settings(str(Path(__file__).with_name("reviews.toml")))
EXTENSIONS, DEFAULT_LANGUAGE = SETTINGS["common"]["extensions"], SETTINGS["common"]["default_language"]
PROMPTS = SETTINGS["prompts"]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_attributes").select("delivery_id", "note")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return R.changed_files(table(spark, d, "st_diff"), EXTENSIONS)


def first_lines(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("delivery_id", X.first_line(F.col("note")).alias("line"))


def trigger_filter(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).where(X.asks_for_review(F.col("note"))).select("delivery_id")


def find_language(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("delivery_id", X.language_code(F.col("note")).alias("lang"))


def _templates(spark: SparkSession) -> DataFrame:
    return R.template_table(spark, SETTINGS["templates"])


def language_fallback(spark: SparkSession, d: str) -> DataFrame:
    return R.chosen_language(find_language(spark, d), "lang", _templates(spark), DEFAULT_LANGUAGE).select("delivery_id", "lang")


def template_languages(spark: SparkSession, d: str) -> DataFrame:
    """(lang) with templates of both kinds, from a scan of a folder of template files; files of other names are passed over."""
    folder = f"{checkpoint_dir(spark)}/templates-{uuid.uuid4().hex}"
    names = [(f"{kind}.{lang}.md", text) for kind, by_lang in SETTINGS["templates"].items() for lang, text in by_lang.items()]
    for name, text in [*names, ("notes.md", "no template")]:
        write_text(spark, f"{folder}/{name}", text)
    found = checkpointed(languages(templates(spark, folder)))
    remove(spark, folder)
    return found


def review_requests(spark: SparkSession, d: str) -> DataFrame:
    """(project_id, note_id, review_id, delivery_id, lang) of the notes that ask for a review of a merge request."""
    return R.review_requests(table(spark, d, "object_attributes"), _templates(spark), DEFAULT_LANGUAGE)


def log_preview(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("delivery_id", X.preview(F.col("note")).alias("line"))


def event_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = decoded(table(spark, d, "github_event"), "payload", GITHUB_SCHEMA)
    return rows.select("event_row", F.col("event").isNotNull().alias("valid"), F.col("event.action").alias("action"), F.col("event.comment.id").try_cast("bigint").alias("comment_id"), F.col("event.repository.id").try_cast("bigint").alias("repo_id"))


#: Fields of an event by name, each a path of the payload.
DETAILS = {
    "sender": "$.sender.login", "repository": "$.repository.full_name", "owner": "$.repository.owner.login", "title": "$.issue.title", "number": "$.issue.number", "issue_author": "$.issue.user.login",
    "comment_author": "$.comment.user.login", "comment_created": "$.comment.created_at", "comment_url": "$.comment.url", "association": "$.comment.author_association", "private": "$.repository.private",
}


def event_details(spark: SparkSession, d: str) -> DataFrame:
    """(event_row and DETAILS as text) of every event that is one JSON object."""
    rows = whole_events(table(spark, d, "github_event"), "payload").where("event IS NOT NULL")
    return rows.select("event_row", *[F.try_variant_get("event", path, "string").alias(name) for name, path in DETAILS.items()])


def pr_number(spark: SparkSession, d: str) -> DataFrame:
    rows = decoded(table(spark, d, "github_event"), "payload", GITHUB_SCHEMA)
    return rows.where("event.issue.pull_request.url IS NOT NULL").select("event_row", X.number_of_request(F.col("event.issue.pull_request.url")).alias("number"))


def file_extension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "st_diff").select("diff_id", X.file_extension(F.col("new_path")).alias("ext"))


def path_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "st_diff").select("diff_id", X.chosen_path(F.col("new_path"), F.col("old_path")).alias("path"))


def extension_filter(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("review_id", "ord", "diff_id", "path")


def empty_review_guard(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "merge_request").where("id IS NOT NULL").select(F.col("id").alias("review_id")).distinct()
    return R.without_files(requests, _files(spark, d))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return R.summarized(_files(spark, d), PROMPTS["summary"]).select("diff_id", "path", "summary")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return R.changes_json(R.summarized(_files(spark, d), PROMPTS["summary"]))


def changes_json(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("changes", "changes ARRAY<STRUCT<path: STRING, summary: STRING>>")["changes"]
    return _changes(spark, d).select("review_id", "n_files", F.array_join(F.transform(parsed, lambda x: F.concat(x["path"], F.lit("="), x["summary"])), "|").alias("changes"))


def planner_prompt(spark: SparkSession, d: str) -> DataFrame:
    """What the planner is asked, as the instruction and the fenced JSON's first entry and length."""
    asked = _changes(spark, d).select("review_id", R.planner_prompt(PROMPTS["plan"], F.col("changes")).alias("prompt"))
    fenced = F.split("prompt", "```")
    path = F.get_json_object(F.regexp_replace(fenced[1], r"\Ajson\n", ""), "$.changes[0].path")
    return asked.select("review_id", F.regexp_replace(fenced[0], r"\n\z", "").alias("instruction"), path.alias("first_path"))


def plan_explode(spark: SparkSession, d: str) -> DataFrame:
    return R.assignments(_changes(spark, d), PROMPTS["plan"])


def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.looked_up(plan_explode(spark, d), _files(spark, d)).select("review_id", "assign_no", "pos", "path", F.length("diff").alias("diff_chars"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    wanted = R.review_languages(files, review_requests(spark, d), DEFAULT_LANGUAGE)
    return R.prompts(R.looked_up(checkpointed(plan_explode(spark, d)), files), wanted, _templates(spark))


def review_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d).select("review_id", "lang", "assign_no", "n_paths", F.length("prompt").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


def reduce_reviews(spark: SparkSession, d: str) -> DataFrame:
    replies = checkpointed(complete_rows(_prompts(spark, d), ("review_id", "lang", "assign_no"), "executor", "prompt", "review"))
    return R.reduced(replies, _templates(spark), PROMPTS["merge"])


def _reviewed(spark: SparkSession, d: str, notes: DataFrame) -> DataFrame:
    """(project_id, note_id, delivery_id, lang, body): the review of each request among the notes, where there is one."""
    found = _templates(spark)
    requests = checkpointed(R.review_requests(notes, found, DEFAULT_LANGUAGE))
    wanted = requests.select("review_id", "lang").distinct()
    # Only the files of requests are reviewed.
    files = checkpointed(_files(spark, d).join(wanted.select("review_id").distinct(), "review_id", "left_semi"))
    summaries = checkpointed(R.summarized(files, PROMPTS["summary"]))
    plan = checkpointed(R.assignments(R.changes_json(summaries), PROMPTS["plan"]))
    asked = R.prompts(R.looked_up(plan, files), wanted, found)
    replies = checkpointed(complete_rows(asked, ("review_id", "lang", "assign_no"), "executor", "prompt", "review"))
    bodies = R.reduced(replies, found, PROMPTS["merge"])
    return requests.join(bodies, ["review_id", "lang"]).select("project_id", "note_id", "delivery_id", "lang", "body")


def stream_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Raw note events from a landing folder through decoding, the review and the keyed sink, in two batches and a replay.

    The body of a note is the review of its last request, by delivery, whatever batch that came in.
    """
    folder = f"{checkpoint_dir(spark)}/reviews-{uuid.uuid4().hex}"
    notes = table(spark, d, "object_attributes").where("noteable_type = 'MergeRequest' AND id IS NOT NULL")
    a = F.struct(F.col("id"), F.col("note"), F.col("noteable_type"), F.col("noteable_id"))
    event = F.struct(F.lit("note").alias("object_kind"), a.alias("object_attributes"), F.struct(F.col("project_id").alias("id")).alias("project"), F.struct(F.col("noteable_id").alias("id")).alias("merge_request"))
    raw = notes.select(F.col("delivery_id").alias("event_row"), F.to_json(event).alias("payload"))
    sink = KeyedSink(f"{folder}/table", ("project_id", "note_id"), "delivery_id")
    # The later half lands first: a late older event must not overwrite a newer one.
    for half in ("event_row % 2 = 1", "event_row % 2 = 0"):
        land(raw.where(half), f"{folder}/in")
        query = start(note_events(landing_stream(spark, f"{folder}/in", "event_row LONG, payload STRING")), sink, f"{folder}/state", lambda batch: _reviewed(batch.sparkSession, d, batch))
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    result = checkpointed(sink.read(spark))
    remove(spark, folder)
    return result


def project_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_attributes").groupBy("project_id").agg(F.count("*").alias("n"), F.count_distinct("noteable_type").alias("kinds"))


def stream_comments(spark: SparkSession, d: str) -> DataFrame:
    """Raw events as a stream into the keyed sink; the sink's table when the stream has read all."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, d, "github_event")
    # As a pattern, so that the source takes a single file as well as a folder of files.
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/github_event.parque[t]")
    sink = KeyedSink(f"{folder}/table", ("repo_id", "comment_id"), "event_row")
    query = start(comment_stream(stream), sink, f"{folder}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    result = checkpointed(sink.read(spark))
    remove(spark, folder)
    return result


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (first_lines, trigger_filter, find_language, template_languages, language_fallback, review_requests, log_preview, event_decode, event_details, pr_number, file_extension, path_choice, extension_filter, empty_review_guard, summaries, changes_json, planner_prompt, plan_explode, path_lookup, review_prompt, reduce_reviews, project_counts, stream_comments, stream_reviews)
    return {f.__name__: f for f in every}


_LINE = r"regexp_extract(regexp_replace(regexp_replace(note, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', ''), '^[^\r\n]*', 0)"
_EXT = "CASE WHEN {0} IS NULL THEN NULL WHEN contains({0}, '.') THEN string_split({0}, '.')[-1] ELSE '' END"
_PATH = "coalesce(nullif(new_path, ''), nullif(old_path, ''))"
_FILES = f"""files AS (SELECT * FROM (SELECT merge_request_id AS review_id, ord, diff_id, {_PATH} AS path, diff FROM st_diff WHERE merge_request_id IS NOT NULL AND diff <> '')
  WHERE {_EXT.format("path")} IN ('cs', 'py', 'go', 'ts'))"""
_SUMMARY = f"'summary ' || md5('{PROMPTS['summary']}' || chr(10) || path || chr(10) || chr(10) || diff)"
_LANG = r"coalesce(regexp_extract({0}, '(?s)^[^/]*(?:(?:/[^a-zA-Z].|/[a-zA-Z][^a-zA-Z]|/[a-zA-Z]{{2}}[^\s\p{{Z}}])[^/]*)*/([a-zA-Z]{{2}})(?:[\s\p{{Z}}]|$)', 1), '')".format(_LINE)
_VALUES = ", ".join(f"('{kind}', '{lang}', '{text}')" for kind, by_lang in SETTINGS["templates"].items() for lang, text in by_lang.items())
_TEMPLATES = f"""templates AS (SELECT * FROM (VALUES {_VALUES}) AS t(kind, lang, template)),
  known AS (SELECT lang FROM templates GROUP BY lang HAVING count(DISTINCT kind) = 2)"""
_CHOSEN = f"CASE WHEN {_LANG} IN (SELECT lang FROM known) THEN {_LANG} ELSE '{DEFAULT_LANGUAGE}' END"
_REQUESTS = f"""{_TEMPLATES}, requests AS (SELECT project_id, id AS note_id, TRY_CAST(noteable_id AS BIGINT) AS review_id, delivery_id, {_CHOSEN} AS lang FROM object_attributes
    WHERE noteable_type = 'MergeRequest' AND id IS NOT NULL AND TRY_CAST(noteable_id AS BIGINT) IS NOT NULL AND regexp_matches({_LINE}, '(?i)/review'))"""
_PLAN = f"""{_FILES}, plan AS (SELECT review_id, path,
    CAST(dense_rank() OVER (PARTITION BY review_id ORDER BY {_EXT.format("path")}) - 1 AS INTEGER) AS assign_no,
    CAST(row_number() OVER (PARTITION BY review_id, {_EXT.format("path")} ORDER BY ord NULLS FIRST, diff_id) - 1 AS INTEGER) AS pos FROM files)"""
_LOOKUP = f"""{_PLAN}, first AS (SELECT review_id, path, diff FROM (SELECT *, row_number() OVER (PARTITION BY review_id, path ORDER BY ord NULLS FIRST, diff_id) AS n FROM files) WHERE n = 1),
  found AS (SELECT p.review_id, p.assign_no, p.pos, p.path, f.diff FROM plan p LEFT JOIN first f USING (review_id, path))"""
#: Prompts for the (review_id, lang) of "wanted", and what comes of them.
_PROMPTS = f"""{_LOOKUP}, {_REQUESTS}, wanted AS ({{wanted}}),
  bodies AS (SELECT review_id, assign_no, count(*) AS n_paths, string_agg('# ' || path || chr(10) || diff || chr(10), '' ORDER BY pos) AS body FROM found GROUP BY ALL),
  prompts AS (SELECT review_id, w.lang, assign_no, n_paths, t.template || chr(10) || chr(10) || body AS prompt FROM bodies JOIN wanted w USING (review_id) LEFT JOIN (SELECT * FROM templates WHERE kind = 'review') t ON t.lang = w.lang)"""
_REDUCED = f"""{_PROMPTS}, done AS (SELECT review_id, lang, assign_no, 'review ' || md5(prompt) AS review FROM prompts WHERE prompt IS NOT NULL),
  joined AS (SELECT review_id, lang, count(*) AS n_reviews, min_by(review, assign_no) AS sole, string_agg(review || chr(10) || chr(10), '' ORDER BY assign_no) AS reviews FROM done GROUP BY ALL),
  reduced AS (SELECT review_id, j.lang, n_reviews, CASE WHEN n_reviews > 1 THEN 'review ' || md5(coalesce(template || chr(10) || chr(10), '{PROMPTS['merge']}' || chr(10)) || reviews) ELSE sole END AS body
    FROM joined j LEFT JOIN (SELECT * FROM templates WHERE kind = 'organize') t ON t.lang = j.lang)"""
_LAST = f"SELECT f.review_id, coalesce(r.lang, '{DEFAULT_LANGUAGE}') AS lang FROM (SELECT DISTINCT review_id FROM files) f LEFT JOIN (SELECT review_id, max_by(lang, delivery_id) AS lang FROM requests GROUP BY review_id) r USING (review_id)"
_VALID = "json_valid(payload) AND json_type(payload) = 'OBJECT'"


def oracle_sql() -> dict[str, str]:
    event = "SELECT event_row, {} FROM (SELECT event_row, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM github_event) {}"
    return {
        "first_lines": f"SELECT delivery_id, {_LINE} AS line FROM object_attributes",
        "trigger_filter": f"SELECT delivery_id FROM object_attributes WHERE regexp_matches({_LINE}, '(?i)/review')",
        "find_language": f"SELECT delivery_id, {_LANG} AS lang FROM object_attributes",
        "template_languages": f"WITH {_TEMPLATES} SELECT lang FROM known",
        "language_fallback": f"WITH {_TEMPLATES} SELECT delivery_id, {_CHOSEN} AS lang FROM object_attributes",
        "review_requests": f"WITH {_REQUESTS} SELECT * FROM requests",
        "log_preview": "SELECT delivery_id, left(regexp_extract(note, '^[^\\r\\n]*', 0), 128) AS line FROM object_attributes",
        "event_decode": event.format("coalesce(json_type(p) = 'OBJECT', false) AS valid, json_extract_string(p, '$.action') AS action, TRY_CAST(json_extract_string(p, '$.comment.id') AS BIGINT) AS comment_id, TRY_CAST(json_extract_string(p, '$.repository.id') AS BIGINT) AS repo_id", ""),
        "event_details": event.format(", ".join(f"json_extract_string(p, '{path}') AS {name}" for name, path in DETAILS.items()), "WHERE json_type(p) = 'OBJECT'"),
        "pr_number": event.format("coalesce(TRY_CAST(regexp_extract(regexp_replace(json_extract_string(p, '$.issue.pull_request.url'), '[?#].*$', ''), '[^/]*/?$', 0) AS INTEGER), 0) AS number", "WHERE json_extract_string(p, '$.issue.pull_request.url') IS NOT NULL"),
        "file_extension": f"SELECT diff_id, {_EXT.format('new_path')} AS ext FROM st_diff",
        "path_choice": f"SELECT diff_id, {_PATH} AS path FROM st_diff",
        "extension_filter": f"WITH {_FILES} SELECT review_id, ord, diff_id, path FROM files",
        "empty_review_guard": f"WITH {_FILES} SELECT DISTINCT id AS review_id FROM merge_request m WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.review_id = m.id)",
        "summaries": f"WITH {_FILES} SELECT diff_id, path, {_SUMMARY} AS summary FROM files",
        "changes_json": f"WITH {_FILES} SELECT review_id, count(*) AS n_files, string_agg(path || '=' || {_SUMMARY}, '|' ORDER BY ord NULLS FIRST, diff_id) AS changes FROM files GROUP BY review_id",
        "plan_explode": f"WITH {_PLAN} SELECT review_id, assign_no, pos, path FROM plan",
        "path_lookup": f"WITH {_LOOKUP} SELECT review_id, assign_no, pos, path, CAST(length(diff) AS INTEGER) AS diff_chars FROM found",
        "planner_prompt": f"WITH {_FILES} SELECT review_id, '{PROMPTS['plan']}' AS instruction, first(path ORDER BY ord NULLS FIRST, diff_id) AS first_path FROM files GROUP BY review_id",
        "review_prompt": f"WITH {_PROMPTS.replace('{wanted}', _LAST)} SELECT review_id, lang, assign_no, n_paths, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM prompts",
        "reduce_reviews": f"WITH {_REDUCED.replace('{wanted}', _LAST)} SELECT review_id, lang, n_reviews, body FROM reduced",
        "stream_reviews": f"WITH {_REDUCED.replace('{wanted}', 'SELECT DISTINCT review_id, lang FROM requests')} SELECT project_id, note_id, delivery_id, lang, body FROM requests JOIN reduced USING (review_id, lang) QUALIFY row_number() OVER (PARTITION BY project_id, note_id ORDER BY delivery_id DESC) = 1",
        "project_counts": "SELECT project_id, count(*) AS n, count(DISTINCT noteable_type) AS kinds FROM object_attributes GROUP BY project_id",
        "stream_comments": event.format("TRY_CAST(json_extract_string(p, '$.comment.id') AS BIGINT) AS comment_id, TRY_CAST(json_extract_string(p, '$.repository.id') AS BIGINT) AS repo_id, json_extract_string(p, '$.comment.body') AS body", "WHERE json_type(p) = 'OBJECT' AND TRY_CAST(json_extract_string(p, '$.comment.id') AS BIGINT) IS NOT NULL AND TRY_CAST(json_extract_string(p, '$.repository.id') AS BIGINT) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY comment_id, repo_id ORDER BY event_row DESC) = 1"),
    }
