import importlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from threshline.functions import text as X
from threshline.operators import reviews as R
from threshline.operators.models import RoleSettings, StubClient, complete_rows, role_settings
from threshline.plans.reviews import SETTINGS
from threshline.session import remove
from threshline.sources.events import GITHUB_SCHEMA, decoded, land, landing_stream, languages, note_events, settings, templates, whole_events
from threshline.streaming.sinks import HostSettings, KeyedSink, comment_stream, posted, start

COMMANDS = {"/review": "", "/review /en": "en", "/REVIEW /EN": "EN", "/re/en": "", "/rev/en": "en", "/a/en": "", "/12/en": "en", "/xx /en": "xx", "　 /review /ja \nrest /en": "ja", "": "", None: ""}


def values(spark, function, given, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], f"k INT, x {kind}")
    return [r[1] for r in df.select("k", function(F.col("x"))).orderBy("k").collect()]


def test_text_functions(spark):
    assert values(spark, X.language_code, COMMANDS) == list(COMMANDS.values())
    assert values(spark, X.first_line, ["  a b \r\n c", "\n\n x", None]) == ["a b ", "x", None]
    assert values(spark, X.asks_for_review, ["please /Review", "x\n/review", None]) == [True, False, False]
    assert values(spark, X.number_of_request, ["https://h/p/12?x=1", "https://h/p/12/", "https://h/p/x", "https://h", None, "no address"]) == [12, 0, 0, 0, 0, 0]
    assert values(spark, X.file_extension, ["a.b/c", "a", "x.CS", "", None, "a."]) == ["b/c", "", "CS", "", None, ""]
    assert values(spark, X.preview, ["y" * 200 + "\nz", " a", None]) == ["y" * 128, " a", None]


def test_decode(spark):
    rows = [(1, '{"action":"x","comment":{"id":12345678901,"body":"b"},"more":1}'), (2, '{"comment":'), (3, "[]"), (4, None), (5, '{"comment":{"id":"7"}}'), (6, "null")]
    got = decoded(spark.createDataFrame(rows, "k INT, p STRING"), "p", GITHUB_SCHEMA).select("k", "event.comment.id", F.col("event").isNotNull()).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "12345678901", True), (2, None, False), (3, None, False), (4, None, False), (5, "7", True), (6, None, False)]


def test_whole_events(spark):
    rows = [(1, '{"a":{"b":[1,{"c":"x"}]},"long":123456789012}'), (2, '{"a":'), (3, "[1]"), (4, None), (5, '"x"'), (6, "{}")]
    got = whole_events(spark.createDataFrame(rows, "k INT, p STRING"), "p").select("k", F.col("event").isNotNull(), F.try_variant_get("event", "$.a.b[1].c", "string"), F.try_variant_get("event", "$.long", "long")).orderBy("k")
    assert [tuple(r) for r in got.collect()] == [(1, True, "x", 123456789012), *((k, k == 6, None, None) for k in range(2, 7))]


def test_templates(spark, tmp_path):
    for name in ("review.en.md", "organize.en.md", "review.ja.md", "notes.md"):
        (tmp_path / name).write_text(name)
    found = templates(spark, str(tmp_path))
    assert found.count() == 3 and [r.lang for r in languages(found).collect()] == ["en"]


def test_lookup_and_prompt(spark):
    files = spark.createDataFrame([(1, 0, 1, "a.cs", "first"), (1, 1, 2, "a.cs", "second"), (1, 2, 3, "b.py", "third")], "review_id LONG, ord INT, diff_id LONG, path STRING, diff STRING")
    plan = spark.createDataFrame([(1, 0, 0, "b.py"), (1, 0, 1, "a.cs"), (1, 0, 2, "invented"), (1, 1, 0, "a.cs"), (1, 1, 1, "a.cs")], "review_id LONG, assign_no INT, pos INT, path STRING")
    found = R.template_table(spark, {"review": {"en": "T", "ja": "U"}, "organize": {"en": "O"}})
    wanted = spark.createDataFrame([(1, "en"), (1, "ja"), (1, "xx"), (2, "en")], "review_id LONG, lang STRING")
    got = {(r.lang, r.assign_no): r.prompt for r in R.prompts(R.looked_up(plan, files), wanted, found).collect()}
    bodies = {0: "\n\n# b.py\nthird\n# a.cs\nfirst\n", 1: "\n\n# a.cs\nfirst\n# a.cs\nfirst\n"}
    assert got == {(lang, k): None if lang == "xx" else t + b for lang, t in (("en", "T"), ("ja", "U"), ("xx", "")) for k, b in bodies.items()}


def test_languages_need_both_templates(spark):
    found = R.template_table(spark, {"review": {"en": "T", "ja": "U", "fr": "V"}, "organize": {"en": "O", "ja": "P"}})
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["en", "ja", "fr", "EN", "", None])], "k INT, lang STRING")
    assert [r.lang for r in R.chosen_language(rows, "lang", found, "en").orderBy("k").collect()] == ["en", "ja", "en", "en", "en", "en"]


def test_settings_of_roles_and_hosts(tmp_path):
    assert role_settings(SETTINGS)["executor"] == RoleSettings("stub", "You review changes.", temperature=0.2, effort=3, output=1, timeout_s=1200)
    assert RoleSettings("m", effort=-1, output=7) == RoleSettings("m", effort=0, output=2)
    assert "hidden" not in repr(HostSettings("gitlab", "https://h.example", "hidden"))
    (tmp_path / "s.toml").write_text("[a]\nb = 1")
    assert settings(str(tmp_path / "s.toml")) == {"a": {"b": 1}}


def test_files_of_a_pull_request(spark):
    rows = [(1, 0, 1, "a.cs", None, "p", "added"), (1, 1, 2, "b.cs", "o.cs", "q", "renamed"), (1, 2, 3, "c.md", None, "r", "modified"), (1, 3, 4, "d.cs", None, None, "modified")]
    df = R.pull_request_files(spark.createDataFrame(rows, "merge_request_id LONG, ord INT, diff_id LONG, filename STRING, previous_filename STRING, patch STRING, status STRING"))
    assert [(r.path, r.diff) for r in R.changed_files(df, ["cs"]).orderBy("ord").collect()] == [("a.cs", "p"), ("b.cs", "q")] and [r.renamed_file for r in df.orderBy("ord").collect()] == [False, True, False, False]


class Host:
    def overwrite(self, key, body):
        if body == "bad":
            raise ValueError(key)


def test_posting_errors_stay_in_their_row(spark):
    df = spark.createDataFrame([("gitlab", 1, "x"), ("gitlab", 2, "bad")], "provider STRING, note LONG, body STRING")
    assert sorted((r.note, r.error) for r in posted(df, ("provider", "note"), "body", Host).collect()) == [(1, None), (2, "('gitlab', 2)")]


def test_note_events_land_and_late_ones_change_nothing(spark, tmp_path):
    event = lambda k, i, note: (k, json.dumps({"object_kind": "note", "object_attributes": {"id": i, "note": note, "noteable_type": "MergeRequest"}, "project": {"id": 5}, "merge_request": {"id": 9, "iid": 2}}))
    sink = KeyedSink(str(tmp_path / "out"), ("project_id", "iid", "id"), "delivery_id")
    for batch in ([event(3, 1, "new"), event(4, 2, "b"), (7, "{"), (8, None)], [event(1, 1, "old"), event(5, 2, "c")], [event(5, 2, "c")]):
        land(spark.createDataFrame(batch, "event_row LONG, payload STRING"), str(tmp_path / "in"))
        stream = landing_stream(spark, str(tmp_path / "in"), "event_row LONG, payload STRING")
        start(note_events(stream), sink, str(tmp_path / "state")).awaitTermination()
    got = sorted(((r.project_id, r.iid, r.id), r.note, r.noteable_id) for r in sink.read(spark).collect())
    assert got == [((5, 2, 1), "new", "9"), ((5, 2, 2), "c", "9")]
    remove(spark, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


class Broken:
    def complete(self, role, prompt, schema=None):
        if "bad" in prompt:
            raise RuntimeError(prompt)
        return prompt.upper()


def test_rows_fail_alone_and_reduce(spark):
    df = spark.createDataFrame([(1, "en", 0, "a"), (1, "en", 1, "b"), (1, "xx", 0, "a"), (1, "xx", 1, "b"), (2, "en", 0, "c"), (3, "en", 0, "bad"), (4, "en", 0, None)], "review_id LONG, lang STRING, assign_no INT, p STRING")
    replies = complete_rows(df, ("review_id", "lang", "assign_no"), "executor", "p", "review", Broken, parallel=3)
    assert sorted((r.review_id, r.lang, r.assign_no, r.review) for r in replies.collect()) == [(1, "en", 0, "A"), (1, "en", 1, "B"), (1, "xx", 0, "A"), (1, "xx", 1, "B"), (2, "en", 0, "C"), (3, "en", 0, ""), (4, "en", 0, "")]
    found = R.template_table(spark, {"organize": {"en": "t"}})
    assert sorted(tuple(r) for r in R.reduced(replies, found, "default:", Broken).collect()) == [(1, "en", 2, "T\n\nA\n\nB\n\n"), (1, "xx", 2, "DEFAULT:\nA\n\nB\n\n"), (2, "en", 1, "C")]


def test_planner_reply_that_does_not_parse(spark):
    changes = spark.createDataFrame([(1, "x")], "review_id LONG, changes STRING")
    assert R.assignments(changes, "plan", Broken).collect() == []


def test_typed_call_has_the_schema_and_the_fenced_json():
    reply = StubClient().complete("planner", 'p\n```json\n{"changes":[{"path":"b.py"},{"path":"a.cs"},{"path":"c.py"}]}\n```', R.PLAN_JSON_SCHEMA)
    assert [a["paths"] for a in json.loads(reply)["assigns"]] == [["a.cs"], ["b.py", "c.py"]] and json.loads(R.PLAN_JSON_SCHEMA)["required"] == ["assigns"]


def test_stream_equals_batch_and_replay(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(k, json.dumps({"comment": {"id": k % 3, "body": f"b{k}"}, "repository": {"id": 1}})) for k in range(9)] + [(9, "no")]
    df = spark.createDataFrame(rows, "event_row LONG, payload STRING")
    df.coalesce(1).write.parquet(str(source))
    sink = KeyedSink(str(tmp_path / "out"), ("repo_id", "comment_id"), "event_row")
    start(comment_stream(spark.readStream.schema(df.schema).parquet(str(source))), sink, str(tmp_path / "state")).awaitTermination()
    want = sorted((1, k % 3, f"b{k}", k) for k in (6, 7, 8))
    assert sorted(tuple(r) for r in sink.read(spark).collect()) == want
    sink.write(comment_stream(df), 0)
    assert sorted(tuple(r) for r in sink.read(spark).collect()) == want


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


ENTRY = importlib.import_module("__spark_entry__")


@pytest.mark.parametrize("name", sorted(ENTRY.oracle_sql()))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for t in ("object_attributes", "merge_request", "issue", "st_diff", "github_event", "documents", "projects"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = ENTRY.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = connection.execute(ENTRY.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr) == want
