"""Changed files grouped, looked up, joined to prompts in order, and reduced to one text per request and language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threshline.functions.text import asks_for_review, chosen_path, file_extension, language_code
from threshline.operators.models import ModelClient, StubClient, complete_rows
from threshline.sources.events import languages

PLAN_SCHEMA = "assigns ARRAY<STRUCT<reviewer_number: INT, paths: ARRAY<STRING>>>"
#: The same as a model is told it.
PLAN_JSON_SCHEMA = (
    '{"type":"object","properties":{"assigns":{"type":"array","items":{"type":"object","properties":{"reviewer_number":{"type":"integer"},'
    '"paths":{"type":"array","items":{"type":"string"}}},"required":["reviewer_number","paths"]}}},"required":["assigns"]}'
)


def template_table(spark: SparkSession, templates: dict[str, dict[str, str]]) -> DataFrame:
    """(kind, lang, template) of the settings' templates, as a table without a scan."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(lang).alias("lang"), F.lit(text).alias("template")) for kind, by_lang in templates.items() for lang, text in by_lang.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def chosen_language(rows: DataFrame, lang: str, templates: DataFrame, default: str) -> DataFrame:
    """``rows`` with the column ``lang`` replaced by ``default`` where it has not both templates.  Case counts.

    Templates are a list of a settings file or folder, a row a language and kind, so the lookup is broadcast.
    """
    known = F.broadcast(languages(templates).select(F.col("lang").alias("_known")))
    return rows.join(known, F.col(lang) == F.col("_known"), "left").withColumn(lang, F.coalesce("_known", F.lit(default))).drop("_known")


def review_requests(notes: DataFrame, templates: DataFrame, default: str) -> DataFrame:
    """(project_id, note_id, review_id, delivery_id, lang) of every note on a merge request that asks for a review."""
    asked = notes.where((F.col("noteable_type") == "MergeRequest") & F.col("id").isNotNull() & asks_for_review(F.col("note")))
    rows = asked.select("project_id", F.col("id").alias("note_id"), F.col("noteable_id").try_cast("bigint").alias("review_id"), "delivery_id", language_code(F.col("note")).alias("lang"))
    return chosen_language(rows.where("review_id IS NOT NULL"), "lang", templates, default)


def review_languages(files: DataFrame, requests: DataFrame, default: str) -> DataFrame:
    """(review_id, lang): the language of the last request for a review of each merge request with files, else the default."""
    last = requests.groupBy("review_id").agg(F.max_by("lang", "delivery_id").alias("lang"))
    return files.select("review_id").distinct().join(last, "review_id", "left").select("review_id", F.coalesce("lang", F.lit(default)).alias("lang"))


def changed_files(diffs: DataFrame, extensions: list[str]) -> DataFrame:
    """(review_id, ord, diff_id, path, diff) of files with a listed extension and a diff; the list is exact in case."""
    path = chosen_path(F.col("new_path"), F.col("old_path"))
    rows = diffs.where("merge_request_id IS NOT NULL AND diff <> ''").select(F.col("merge_request_id").alias("review_id"), "ord", "diff_id", path.alias("path"), "diff")
    return rows.where(file_extension(F.col("path")).isin(extensions))


def pull_request_files(files: DataFrame) -> DataFrame:
    """Files as a pull request lists them (filename, previous_filename, patch, status) in the columns ``changed_files`` reads."""
    status = F.col("status")
    return files.withColumns({
        "new_path": F.col("filename"), "old_path": F.coalesce("previous_filename", "filename"), "diff": F.col("patch"),
        "new_file": status == "added", "renamed_file": status == "renamed", "deleted_file": status == "removed",
    })


def without_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The requests that have no file to look at."""
    return requests.join(files.select("review_id").distinct(), "review_id", "left_anti")


def summarized(files: DataFrame, instruction: str, client: Callable[[], ModelClient] = StubClient) -> DataFrame:
    """(review_id, ord, diff_id, path, summary); a failed call leaves it empty, and then the file is not offered to the planner."""
    prompt = F.concat(F.lit(instruction + "\n"), "path", F.lit("\n\n"), F.coalesce("diff", F.lit("")))
    return complete_rows(files.withColumn("prompt", prompt), ("review_id", "ord", "diff_id", "path"), "assistant", "prompt", "summary", client)


def changes_json(summaries: DataFrame) -> DataFrame:
    """(review_id, n_files, changes): the files of a request in order as one JSON text.  A group is one request's files."""
    entry = F.struct("ord", "diff_id", "path", "summary")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["path"].alias("path"), x["summary"].alias("summary")))
    listed = summaries.where("summary <> ''").groupBy("review_id").agg(F.count("*").alias("n_files"), ordered.alias("changes"))
    return listed.select("review_id", "n_files", F.to_json(F.struct("changes")).alias("changes"))


def planner_prompt(instruction: str, changes: Column) -> Column:
    """The instruction and the changes as fenced JSON."""
    return F.concat(F.lit(instruction + "\n```json\n"), changes, F.lit("\n```"))


def assignments(changes: DataFrame, instruction: str, client: Callable[[], ModelClient] = StubClient) -> DataFrame:
    """(review_id, assign_no, pos, path) of the planner's reply; a reply that does not parse, or is null, has no rows."""
    asked = changes.select("review_id", planner_prompt(instruction, F.col("changes")).alias("prompt"))
    replies = complete_rows(asked, ("review_id",), "planner", "prompt", "reply", client, None, PLAN_JSON_SCHEMA)
    plan = replies.select("review_id", F.from_json("reply", PLAN_SCHEMA).alias("plan"))
    groups = plan.select("review_id", F.posexplode("plan.assigns").alias("assign_no", "a"))
    return groups.select("review_id", "assign_no", F.posexplode("a.paths").alias("pos", "path"))


def looked_up(assigned: DataFrame, files: DataFrame) -> DataFrame:
    """Each assigned path with the diff of the first file of that path, or null; repeated paths stay repeated.

    The first file is found by its keys; only the texts that are asked for are then joined, once, by the file's id.
    """
    first = files.groupBy("review_id", "path").agg(F.min(F.struct("ord", "diff_id")).alias("_first")).select("review_id", "path", "_first.diff_id")
    found = assigned.join(first, ["review_id", "path"], "left")
    return found.join(files.select("diff_id", "diff"), "diff_id", "left").drop("diff_id")


def prompts(found: DataFrame, requests: DataFrame, templates: DataFrame) -> DataFrame:
    """(review_id, lang, assign_no, n_paths, prompt): the template, then path and diff of each found file in order.

    ``requests``: (review_id, lang).  The template is that of the language; where there is none, the prompt is null.
    """
    part = F.when(F.coalesce("diff", F.lit("")) != "", F.concat(F.lit("# "), "path", F.lit("\n"), "diff", F.lit("\n"))).otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    grouped = found.groupBy("review_id", "assign_no").agg(F.count("*").alias("n_paths"), ordered.alias("parts"))
    template = F.broadcast(templates.where("kind = 'review'").select("lang", "template"))
    asked = requests.join(template, "lang", "left")
    body = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return grouped.join(asked, "review_id").select("review_id", "lang", "assign_no", "n_paths", F.concat("template", F.lit("\n\n"), body).alias("prompt"))


def reduced(reviews: DataFrame, templates: DataFrame, default: str, client: Callable[[], ModelClient] = StubClient) -> DataFrame:
    """(review_id, lang, n_reviews, body): one review stays as it is, several are merged by the model; empty ones don't count.

    The merge begins with the language's template, or the line ``default`` where it has none.
    """
    ordered = F.array_sort(F.collect_list(F.struct("assign_no", "review")))
    grouped = reviews.where("review <> ''").groupBy("review_id", "lang").agg(F.count("*").alias("n_reviews"), ordered.alias("parts"))
    template = F.broadcast(templates.where("kind = 'organize'").select("lang", "template"))
    joined = F.array_join(F.transform("parts", lambda x: F.concat(x["review"], F.lit("\n\n"))), "")
    begin = F.coalesce(F.concat("template", F.lit("\n\n")), F.lit(default + "\n"))
    prompt = F.when(F.col("n_reviews") > 1, F.concat(begin, joined))
    asked = grouped.join(template, "lang", "left").select("review_id", "lang", "n_reviews", F.col("parts")[0]["review"].alias("only"), prompt.alias("prompt"))
    merged = complete_rows(asked, ("review_id", "lang", "n_reviews", "only"), "executor", "prompt", "merged", client)
    return merged.select("review_id", "lang", "n_reviews", F.when(F.col("n_reviews") > 1, F.col("merged")).otherwise(F.col("only")).alias("body"))
