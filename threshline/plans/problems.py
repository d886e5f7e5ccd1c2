"""Queries of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threshline.functions.timestamps import ABBREVIATIONS, EPOCH_BOUNDS, UNITS
from threshline.operators.deliveries import dropped_deliveries, kept_deliveries
from threshline.operators.flatten import EVENT_CHILDREN, EVENT_FIELDS, REQUEST_CHILDREN, review_child_table, review_children
from threshline.operators.instants import TIME_FIELDS, instants
from threshline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_deliveries(table(spark, sf_dir, "object_attributes"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_deliveries(table(spark, sf_dir, "object_attributes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name) for name in ("object_attributes", "merge_request", "issue")}
    return instants(tables, table(spark, sf_dir, "projects"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_children(table(spark, sf_dir, "github_event"), table(spark, sf_dir, "merge_request"))


def child_table(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: review_child_table(table(spark, sf_dir, "github_event"), table(spark, sf_dir, "merge_request"), kind)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_kept": p1_kept, "p4_found": p4_found, "p6_found": p6_found, **{f"p6_{kind}": child_table(kind) for kind in (*EVENT_CHILDREN, *REQUEST_CHILDREN)}}


_RANKED = """
WITH timed AS (
  SELECT delivery_id, id, CAST(regexp_replace(updated_at, ' ?UTC$', 'Z') AS TIMESTAMPTZ) AS instant FROM object_attributes WHERE id IS NOT NULL
), ranked AS (
  SELECT delivery_id, row_number() OVER (PARTITION BY id ORDER BY instant DESC NULLS LAST, delivery_id) AS n FROM timed
)
"""
_ITEMS = """
  SELECT kind, event_row AS parent_id, CAST(i - 1 AS INTEGER) AS pos, CAST(a AS VARCHAR) AS raw, field FROM (
    SELECT kind, field, event_row, unnest(items) AS a, generate_subscripts(items, 1) AS i FROM (
      SELECT event_row, kind, field,
             CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) WHEN json_type(v) = 'OBJECT' THEN [v] ELSE [] END AS items
      FROM whole, LATERAL (VALUES ('assignee', 'login', json_extract(p, '$.issue.assignees')), ('gh_label', 'name', json_extract(p, '$.issue.labels'))) AS t(kind, field, v)))
"""


_EVENTS = f"""
WITH whole AS (
  SELECT event_row, CAST(payload AS JSON) AS p FROM (SELECT * FROM github_event WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'
), items AS ({_ITEMS}), gh AS (
  SELECT 'user' AS kind, event_row AS parent_id, CAST(0 AS INTEGER) AS pos, json_extract_string(p, '$.issue.user.login') AS child_key, CAST(json_extract(p, '$.issue.user') AS VARCHAR) AS raw FROM whole
  UNION ALL
  SELECT kind, parent_id, pos, CASE WHEN json_type(raw) = 'OBJECT' THEN json_extract_string(raw, '$.' || field) WHEN json_type(raw) = 'VARCHAR' AND kind = 'gh_label' THEN json_extract_string(raw, '$') END, raw FROM items
)"""


def _event_table(kind: str) -> str:
    fields = ", ".join(f"""json_extract_string(raw, '$.{f}') AS "{f}\"""" for f in EVENT_FIELDS[kind])
    return f"{_EVENTS} SELECT parent_id, pos, child_key, {fields} FROM gh WHERE kind = '{kind}' AND child_key <> ''"


#: The forms of times, as expressions with groups for year, month, day, hour, minute, second, fraction, half of day, zone and bracketed region.
_Z = r"((?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?"
_T = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_C = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_M = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
_FORMS = (
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_T} ?{_Z}(?:\[([^\]]+)\])?$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))? ?{_Z}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    (rf"^(\d{{4}})/(\d{{2}})/(\d{{2}}) {_T} ?{_Z}$", (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_T} ?{_Z}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 0)),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_C}(?: ?([AP]M))? ?{_Z}$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 0)),
    (rf"^(?:[A-Z]{{3}}[a-z]*, )?(\d{{1,2}}) {_M} (\d{{4}}) {_T} ?{_Z}$", (3, 2, 1, 4, 5, 6, 7, 0, 8, 0)),
    (rf"^{_M} (\d{{1,2}}),? (\d{{4}}),? {_C}(?: ?([AP]M))? ?{_Z}$", (3, 1, 2, 4, 5, 6, 7, 8, 9, 0)),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日 ?(\d{1,2})時(\d{1,2})分(?:(\d{1,2})秒)?$", (1, 2, 3, 4, 5, 6, 0, 0, 0, 0)),
)


def _instants_sql() -> str:
    names = ("year", "month", "day", "hour", "minute", "second", "fraction", "half", "zone", "bracket")
    form = "CASE " + " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN {n}" for n, (p, _) in enumerate(_FORMS)) + " END"

    def field(k: int) -> str:
        arms = []
        for n, (p, groups) in enumerate(_FORMS):
            if n == 4 and k in (1, 2):  # slashed dates follow the order of the project
                arms.append(f"WHEN {n} THEN CASE WHEN date_order = 'mdy' THEN regexp_extract(t, '(?i){p}', {groups[3 - k]}) ELSE regexp_extract(t, '(?i){p}', {groups[k]}) END")
            elif groups[k]:
                arms.append(f"WHEN {n} THEN regexp_extract(t, '(?i){p}', {groups[k]})")
        return f"coalesce(CASE form {' '.join(arms)} END, '') AS f_{names[k]}"

    offsets = ", ".join(f"('{k}', {v})" for k, v in ABBREVIATIONS.items())
    low, high = EPOCH_BOUNDS
    epochs = " ".join(f"WHEN n >= {low}::HUGEINT * {u} AND n < {high}::HUGEINT * {u} THEN CAST({f'n * {10**6 // u}' if u <= 10**6 else f'n // {u // 10**6}'} AS BIGINT)" for u in UNITS)
    read = "epoch_us(timezone(zone_name, make_timestamptz({0})))"
    rows = " UNION ALL ".join(f"SELECT '{t}' AS src, {k} AS row_key, {p} AS project, {c} AS raw FROM {t} WHERE {c} IS NOT NULL" for t, k, p, c in TIME_FIELDS)
    return f"""
WITH raws AS ({rows}),
texts AS (SELECT src, row_key, time_zone, coalesce(date_order, 'dmy') AS date_order, regexp_replace(regexp_replace(translate(raw, '−‐–', '---'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g') AS t
  FROM raws LEFT JOIN projects ON projects.id = project),
formed AS (SELECT *, {form} AS form, CASE WHEN regexp_matches(t, '^\\d{{9,19}}$') THEN TRY_CAST(t AS HUGEINT) END AS n FROM texts),
fields AS (SELECT *, {", ".join(map(field, range(10)))} FROM formed),
numbers AS (SELECT *, TRY_CAST(f_year AS INTEGER) AS y, TRY_CAST(f_day AS INTEGER) AS d, TRY_CAST(f_minute AS INTEGER) AS mi, coalesce(TRY_CAST(f_second AS INTEGER), 0) AS s, coalesce(TRY_CAST(rpad(left(f_fraction, 6), 6, '0') AS INTEGER), 0) AS us,
    CASE WHEN regexp_matches(f_month, '^[A-Za-z]') THEN (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(f_month, 3))) + 2) // 3 ELSE TRY_CAST(f_month AS INTEGER) END AS mo,
    CASE WHEN f_half = '' THEN TRY_CAST(f_hour AS INTEGER) WHEN TRY_CAST(f_hour AS INTEGER) BETWEEN 1 AND 12 THEN TRY_CAST(f_hour AS INTEGER) % 12 + CASE WHEN upper(f_half) = 'PM' THEN 12 ELSE 0 END END AS h,
    regexp_replace(f_zone, '(?i)^(UTC|GMT)([+-])', '\\2') AS bare, CASE WHEN f_bracket <> '' THEN f_bracket WHEN contains(f_zone, '/') THEN f_zone END AS region FROM fields),
dated AS (SELECT *, CASE WHEN y > 1 AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 AND mo BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31
    THEN epoch_us(TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, s) AS TIMESTAMP)) + us END AS local_us,
    CASE WHEN regexp_matches(bare, '^[+-]\\d{{2}}:?(\\d{{2}})?$') THEN
        CASE WHEN CAST(bare[2:3] AS INTEGER) <= 18 AND coalesce(TRY_CAST(replace(bare, ':', '')[4:5] AS INTEGER), 0) < 60 THEN (CASE WHEN bare[1] = '-' THEN -1 ELSE 1 END) * (CAST(bare[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(replace(bare, ':', '')[4:5] AS INTEGER), 0)) END
      ELSE a.minutes END AS offset_min,
    z.name AS zone_name, CASE {epochs} END AS epoch_value
  FROM numbers LEFT JOIN (VALUES {offsets}) AS a(abbreviation, minutes) ON a.abbreviation = upper(f_zone)
    LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names() WHERE contains(name, '/')) z ON z.name = coalesce(region, CASE WHEN f_zone = '' THEN time_zone END)),
-- The offsets a day before and after give the two candidates of a local time; one that reads back is real.
offsets AS (SELECT *, {read.format("local_us - 86400000000 - 0")} AS r0, {read.format("local_us + 86400000000 - 0")} AS r1 FROM dated),
sides AS (SELECT *, local_us - (r0 - (local_us - 86400000000)) AS early, local_us - (r1 - (local_us + 86400000000)) AS late FROM offsets),
checked AS (SELECT *, {read.format("early")} = local_us AS first_real, {read.format("late")} = local_us AS second_real FROM sides)
SELECT src, row_key, utc_us FROM (
  SELECT src, row_key, CASE WHEN epoch_value IS NOT NULL THEN epoch_value WHEN offset_min IS NOT NULL THEN local_us - CAST(offset_min AS BIGINT) * 60000000
    WHEN zone_name IS NOT NULL AND local_us IS NOT NULL THEN CASE WHEN early = late THEN early WHEN first_real AND second_real THEN least(early, late) WHEN first_real THEN early WHEN second_real THEN late ELSE early END END AS utc_us FROM checked)
WHERE utc_us IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    scalars = "CAST(x.id AS VARCHAR) AS id, x.title AS title, x.color AS color, x.project_id AS project_id, x.created_at AS created_at, CAST(x.template AS VARCHAR) AS template, x.description AS description, x.label_type AS label_type, x.group_id AS group_id"
    return {
        "p1_found": f"{_RANKED} SELECT delivery_id FROM ranked WHERE n > 1",
        "p1_kept": f"{_RANKED} SELECT delivery_id FROM ranked WHERE n = 1 UNION ALL SELECT delivery_id FROM object_attributes WHERE id IS NULL",
        "p4_found": _instants_sql(),
        "p6_found": f"""{_EVENTS}, mr AS (
  SELECT 'label' AS kind, mr_row AS parent_id, CAST(i - 1 AS INTEGER) AS pos, CAST(x.id AS VARCHAR) AS child_key FROM (SELECT mr_row, unnest(labels) AS x, generate_subscripts(labels, 1) AS i FROM merge_request)
  UNION ALL SELECT 'commit', mr_row, 0, last_commit.id FROM merge_request
  UNION ALL SELECT 'commit_author', mr_row, 0, last_commit.author.email FROM merge_request
)
SELECT kind, parent_id, pos, child_key FROM (SELECT kind, parent_id, pos, child_key FROM gh UNION ALL SELECT * FROM mr) WHERE child_key <> ''""",
        **{f"p6_{kind}": _event_table(kind) for kind in EVENT_CHILDREN},
        "p6_label": f"SELECT parent_id, pos, id AS child_key, id, title, color, project_id, created_at, template, description, label_type, group_id FROM (SELECT mr_row AS parent_id, CAST(i - 1 AS INTEGER) AS pos, {scalars} FROM (SELECT mr_row, unnest(labels) AS x, generate_subscripts(labels, 1) AS i FROM merge_request)) WHERE id <> ''",
        "p6_commit": "SELECT mr_row AS parent_id, CAST(0 AS INTEGER) AS pos, last_commit.id AS child_key, last_commit.id AS id, last_commit.message AS message, last_commit.committed_at AS committed_at, last_commit.url AS url FROM merge_request WHERE last_commit.id <> ''",
        "p6_commit_author": "SELECT mr_row AS parent_id, CAST(0 AS INTEGER) AS pos, last_commit.author.email AS child_key, last_commit.author.name AS name, last_commit.author.email AS email FROM merge_request WHERE last_commit.author.email <> ''",
    }
