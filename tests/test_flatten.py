import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threshline.operators.flatten import ELEMENT, EVENT_CHILDREN, REQUEST_CHILDREN, NotOneObject, column_children, column_triples, json_children, triples, review_child_table

WANTED = {path for path, _, _ in EVENT_CHILDREN.values()}
scalars = st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["issue", "user", "labels", "assignees", "name", "login", "é\"\\"]), x, max_size=4), max_leaves=20)


def expected(text):
    """Children by plain parsing."""
    data = json.loads(text)
    issue = data.get("issue") if isinstance(data, dict) else None
    out = []
    for kind, (path, name, bare) in EVENT_CHILDREN.items():
        value = issue.get(path[1]) if isinstance(issue, dict) else None
        for pos, x in enumerate(value if isinstance(value, list) else [value]):
            key = x.get(name) if isinstance(x, dict) else x if bare else None
            if isinstance(key, bool):
                key = str(key).lower()
            if key not in (None, "") and not isinstance(key, (list, dict)):
                out.append((kind, pos, key if isinstance(key, str) else json.dumps(key)))
    return sorted(out)


def children_of(text):
    out = {}
    for path, ordinals, value in triples(text, WANTED):
        for kind, (start, name, bare) in EVENT_CHILDREN.items():
            if path[: len(start)] == start and value:
                rest, pos = path[len(start) :], 0
                if rest[:1] == (ELEMENT,):
                    rest, pos = rest[1:], ordinals[0]
                if rest == (name,) or (rest == () and bare):
                    out[kind, pos] = value
    return sorted((k, p, v) for (k, p), v in out.items())


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["issue", "other"]), values, max_size=2), st.sampled_from([None, 2]))
def test_stream_parser_agrees_with_a_parser(data, indent):
    text = json.dumps(data, indent=indent)
    assert children_of(text) == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(values.map(json.dumps), st.text(alphabet='{}[]",:01truenl\\ ', max_size=12)), st.integers(0, 40))
def test_whole_objects_only(text, cut):
    for t in (text, text[:cut], text + "}"):
        try:
            good = isinstance(json.loads(t), dict)
        except ValueError:
            good = False
        try:
            triples(t, WANTED)
            assert good
        except NotOneObject:
            assert not good


def test_children(spark):
    rows = [
        (1, '{"issue": {"user": {"login": "a", "id": 5}, "labels": [null, "x", {"name": "y"}, {"name": ""}, "x"], "assignees": {"login": "b"}}}', "extra"),
        (1, '{"issue": {"user": {"login": "a"}}}', "extra"), (2, None, None), (3, "", None), (4, "[]", None), (5, '{"issue": null}', None), (6, '{"issue": {"user": {"login": "z"}}', None), (None, '{"issue":{"user":{"login":"q"}}}', None),
    ]
    got = json_children(spark.createDataFrame(rows, "event_row LONG, payload STRING, kind STRING"), "event_row", "payload", EVENT_CHILDREN, ("id",)).collect()
    assert sorted((r.kind, r.parent_id or 0, r.pos, r.child_key) for r in got) == [("assignee", 1, 0, "b"), ("gh_label", 1, 1, "x"), ("gh_label", 1, 2, "y"), ("gh_label", 1, 4, "x"), ("user", 0, 0, "q"), ("user", 1, 0, "a"), ("user", 1, 0, "a")]
    assert [r.fields for r in got if r.kind == "user" and r.fields] == [{"id": "5"}]


def test_repeated_key_and_depth(spark):
    assert children_of('{"issue":{"user":{"login":"a"},"user":{"login":"b"}}}') == [("user", 0, "b")]
    with pytest.raises(NotOneObject):
        triples("[" * 50, WANTED)


def test_columns(spark):
    schema = "mr_row LONG, labels ARRAY<STRUCT<id: LONG, title: STRING>>, last_commit STRUCT<id: STRING, author: STRUCT<name: STRING, email: STRING>>, pos INT"
    rows = [(1, [(5, "a"), None, (None, "b"), (5, "a")], ("c1", ("n", "e@x")), 3), (2, None, None, None), (3, [], ("", None), None)]
    got = column_children(spark.createDataFrame(rows, schema), "mr_row", REQUEST_CHILDREN, {"label": ("title",)}).collect()
    assert sorted((r.kind, r.parent_id, r.pos, r.child_key) for r in got) == [("commit", 1, 0, "c1"), ("commit_author", 1, 0, "e@x"), ("label", 1, 0, "5"), ("label", 1, 3, "5")]
    assert column_children(spark.createDataFrame([], schema), "mr_row", REQUEST_CHILDREN).collect() == []


def test_child_tables_have_all_fields(spark):
    text = '{"issue":{"labels":[{"name":"a","color":"f00","by":{"who":"x","n/m":[1,null,2]}},"b"],"user":{"login":"u","id":5}}}'
    events = spark.createDataFrame([(1, text)], "event_row LONG, payload STRING")
    schema = "mr_row LONG, labels ARRAY<STRUCT<id: LONG, title: STRING, color: STRING>>, last_commit STRUCT<id: STRING, message: STRING, author: STRUCT<name: STRING, email: STRING>>"
    requests = spark.createDataFrame([(7, [(1, "t", None), (2, None, "c")], ("s", "m", ("n", "e")))], schema)
    rows = lambda kind: sorted(tuple(r) for r in review_child_table(events, requests, kind).collect())
    assert rows("gh_label") == [(1, 0, "a", None, "f00", None, None), (1, 1, "b", None, None, None, None)]
    assert rows("user") == [(1, 0, "u", "5", None, None, None, None, None)] and rows("assignee") == []
    every = json_children(events, "event_row", "payload", EVENT_CHILDREN, None).where("kind = 'gh_label'").collect()
    assert sorted((r.pos, r.fields) for r in every) == [(0, {"name": "a", "color": "f00", "by/who": "x", "by/n~1m/0": "1", "by/n~1m/2": "2"}), (1, {"name": "b"})]
    assert rows("label") == [(7, 0, "1", "1", "t", None), (7, 1, "2", "2", None, "c")]
    assert rows("commit") == [(7, 0, "s", "s", "m")] and rows("commit_author") == [(7, 0, "e", "n", "e")]


def test_arrays_in_arrays(spark):
    """Both levels are tables: the children of the second know the position of their parent in the first."""
    assert triples('{"a":[{"b":[{"k":1}]}]}', {("a", ELEMENT, "b")}) == [(("a", ELEMENT, "b", ELEMENT, "k"), (0, 0), "1")]
    text = '{"a":[null,{"k":"p","b":[{"k":1},{"k":2,"c":[7]}]},{"k":"q","b":{"k":3}},{"k":"r","b":[]},5],"k":9}'
    kinds = {"outer": (("a",), "k", False), "inner": (("a", ELEMENT, "b"), "k", False)}
    got = json_children(spark.createDataFrame([(1, text), (2, '{"a":{"k":"s","b":[{"k":4}]}}')], "id LONG, t STRING"), "id", "t", kinds, None).collect()
    assert sorted((r.kind, r.parent_id, r.parent_pos, r.pos, r.child_key) for r in got) == [
        ("inner", 1, [1], 0, "1"), ("inner", 1, [1], 1, "2"), ("inner", 1, [2], 0, "3"), ("outer", 1, [], 1, "p"), ("outer", 1, [], 2, "q"), ("outer", 1, [], 3, "r"), ("outer", 2, [], 0, "s"),
    ]
    assert [r.fields for r in got if r.child_key == "2"] == [{"k": "2", "c/0": "7"}]


def test_column_triples_of_nested_lists():
    values = pa.array([[{"k": 1, "b": [{"x": 5}, None, {"x": 6}]}, None], None, [], [{"k": 2, "b": None}, {"k": 3, "b": [{"x": 7}]}]])
    got = {path: (rows.tolist(), [o.tolist() for o in ordinals], values.to_pylist()) for path, rows, ordinals, values in column_triples(values, ("a",), np.arange(4))}
    assert got[("a", ELEMENT, "k")] == ([0, 0, 3, 3], [[0, 1, 0, 1]], [1, None, 2, 3])
    assert got[("a", ELEMENT, "b", ELEMENT, "x")] == ([0, 0, 0, 3], [[0, 0, 0, 1], [0, 1, 2, 0]], [5, None, 6, 7])
    part = {path: (rows.tolist(), values.to_pylist()) for path, rows, _, values in column_triples(values.slice(2), ("a",), np.arange(2))}
    assert part[("a", ELEMENT, "k")] == ([1, 1], [2, 3])
