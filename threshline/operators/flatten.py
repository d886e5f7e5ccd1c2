"""Nested records as related flat tables that keep the key of their parent row and the position of each child.

A record becomes path-value-ordinal triples: where a scalar stands, what it is, and its position in every array on the
way.  JSON texts give them by one pass of a lexer, only for the paths that are asked for, and a record counts only when
the whole text is one object.  Nested columns give them in columns: all values of a path of a batch with their rows and
ordinals.  Triples with the same repeated ancestor (its path and its ordinals) form one child; each such group is pivoted
into one row of the ancestor's table.  As all triples of a record are in one place, the pivot needs no shuffle.

A child of a child (an array in an array) has the ordinals of all arrays on its way; all but its own are the position of
its parent in the parent's table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A JSON token after optional blanks: string, number, word or sign.
TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null)|([{}\[\],:]))', re.ASCII)
BLANKS = re.compile(r"[ \t\n\r]*")


Path = tuple[str | int, ...]
#: In a path, any element of an array; no key of an object is a number.
ELEMENT = 0


class NotOneObject(ValueError):
    """The text is not one whole JSON object."""


def text_of(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def triples(text: str, wanted: set[Path]) -> list[tuple[Path, tuple[int, ...], str | None]]:
    """(path, ordinals, value) of each scalar at or below a wanted path, in document order.

    ``wanted`` holds paths of keys.  In a path ELEMENT stands for any element of an array, whose position is the next of
    the ordinals; a wanted path may hold it, too.  Of a repeated key the last value counts, as parsers of JSON have it.
    """
    out: list[tuple[Path, tuple[int, ...], str | None]] = []
    match, at, end = TOKEN.match, 0, len(text)
    prefixes = {w[:n] for w in wanted for n in range(len(w) + 1)}
    # Frames: [is object, path, ordinals, next ordinal, whether at or below a wanted path, kept, keys so far].
    stack: list[list] = []
    state = "value"
    path: Path = ()
    ordinals: tuple[int, ...] = ()
    kept = True
    while True:
        m = match(text, at)
        if not m:
            raise NotOneObject
        at, kind = m.end(), m.lastindex
        sign = m[4] if kind == 4 else None
        if not stack and (sign != "{" or state != "value"):
            raise NotOneObject
        if state == "key" or state == "first key":
            if kind == 1:
                frame = stack[-1]
                name = text_of(m[1])
                if frame[5]:
                    path = frame[1] + (name,)
                    kept = frame[4] or path in prefixes
                    if kept:
                        if name in frame[6]:  # a repeated key replaces what it had
                            out[:] = [t for t in out if t[0][: len(path)] != path or t[1][: len(frame[2])] != frame[2]]
                        frame[6].add(name)
                else:
                    kept = False
                ordinals, state = frame[2], "colon"
                continue
            if sign != "}" or state == "key":
                raise NotOneObject
        elif state == "colon":
            if sign != ":":
                raise NotOneObject
            state = "value"
            continue
        elif state == "after":
            frame = stack[-1]
            if sign == ",":
                if frame[0]:
                    state = "key"
                else:
                    frame[3] += 1
                    path, ordinals, kept, state = frame[1], frame[2] + (frame[3],), frame[5], "value"
                continue
            if sign not in ("}", "]") or (sign == "}") != frame[0]:
                raise NotOneObject
        elif state in ("value", "first value"):
            if sign == "{":
                stack.append([True, path, ordinals, 0, kept and (path in wanted or bool(stack) and stack[-1][4]), kept, set()])
                state = "first key"
                continue
            if sign == "[":
                below = kept and (path in wanted or stack[-1][4])
                kept = kept and (below or path + (ELEMENT,) in prefixes)
                stack.append([False, path + (ELEMENT,), ordinals, 0, below, kept, None])
                path, ordinals, state = path + (ELEMENT,), ordinals + (0,), "first value"
                continue
            if kind in (1, 2, 3):
                if kept and path not in prefixes - wanted:
                    out.append((path, ordinals, text_of(m[1]) if kind == 1 else None if m[0].strip() == "null" else m[0].strip()))
                state = "after"
                continue
            if sign != "]" or state != "first value":
                raise NotOneObject
        # A container ends.
        frame = stack.pop()
        if not stack:
            if BLANKS.match(text, at).end() != end:
                raise NotOneObject
            return out
        state = "after"


def pointed(name: str) -> str:
    """A key as JSON pointers write it."""
    return name.replace("~", "~0").replace("/", "~1")


def json_children(df: DataFrame, key: str, text: str, children: dict[str, tuple[Path, str, bool]], fields: tuple[str, ...] | None = ()) -> DataFrame:
    """(kind, parent_id, parent_pos, pos, child_key, fields): one row per child of each JSON text.

    ``children`` maps a kind to (path, name of the key field, whether a bare text may stand for the child).  The map
    ``fields`` has the child's scalars named in ``fields``, or all when it is None, pivoted from its triples.  Scalars of
    deeper levels are named as in a JSON pointer without its first slash ("author/name", "topics/0").  Where the path of a
    kind holds ELEMENT, ``parent_pos`` has the positions of the arrays above the child's own.  Null texts and texts that
    are not one whole object have no children; neither have elements that are null or whose key is null, empty, absent or
    no text or number; positions count all elements.
    """
    wanted = {path for path, _, _ in children.values()}
    by_path = {path: (kind, name, bare) for kind, (path, name, bare) in children.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for parent, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = triples(value, wanted)
                except NotOneObject:
                    continue
                groups: dict[tuple, dict[str, str | None]] = {}
                for path, ordinals, x in found:
                    for n in range(len(path), 0, -1):
                        if path[:n] in by_path:
                            break
                    kind, name, bare = by_path[path[:n]]
                    rest, above = path[n:], path[:n].count(ELEMENT)
                    own = above + (rest[:1] == (ELEMENT,))
                    rest = rest[own - above :]
                    child = groups.setdefault((kind, ordinals[:above], ordinals[above] if own > above else 0), {})
                    if len(rest) > 1 or rest == (ELEMENT,):
                        if fields == ():
                            continue
                        inner = list(ordinals[own:])
                        child["/".join(str(inner.pop(0)) if r == ELEMENT else pointed(r) for r in rest)] = x
                    elif rest:
                        child[pointed(rest[0])] = x
                    elif bare and x is not None:
                        child[pointed(name)] = x
                for (kind, above, pos), child in groups.items():
                    name = children[kind][1]
                    if child.get(pointed(name)):
                        wished = sorted(child) if fields is None else fields
                        for column, x in zip(rows, (kind, parent, above, pos, child[pointed(name)], [(f, child[f]) for f in wished if child.get(f) is not None])):
                            column.append(x)
            types = (pa.string(), batch.schema.field(0).type, pa.list_(pa.int32()), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names)

    names = ["kind", "parent_id", "parent_pos", "pos", "child_key", "fields"]
    kinds = (T.StringType(), df.schema[key].dataType, T.ArrayType(T.IntegerType()), T.IntegerType(), T.StringType(), T.MapType(T.StringType(), T.StringType()))
    return df.where(F.col(text).isNotNull()).select(key, text).mapInArrow(run, T.StructType([T.StructField(c, t) for c, t in zip(names, kinds)]))


def column_triples(values: pa.Array, path: Path, rows: np.ndarray, ordinals: tuple[np.ndarray, ...] = ()) -> Iterator[tuple[Path, np.ndarray, tuple[np.ndarray, ...], pa.Array]]:
    """(path, rows, ordinals, values) of every scalar path of a nested column; paths below one array have equal rows and ordinals.

    Nulls stay in place, so that the groups of one ancestor line up; a null list has no elements.
    """
    if pa.types.is_struct(values.type):
        for field, child in zip(values.type, values.flatten()):
            yield from column_triples(child, path + (field.name,), rows, ordinals)
    elif pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        parent = pc.list_parent_indices(values).to_numpy(zero_copy_only=False).astype(np.int64)
        pos = np.arange(len(parent)) - np.searchsorted(parent, parent)
        yield from column_triples(values.flatten(), path + (ELEMENT,), rows[parent], (*(o[parent] for o in ordinals), pos))
    else:
        yield path, rows, ordinals, values


def narrowed(df: DataFrame, column: str, names: list[str]) -> Column:
    """The named scalars of a nested column alone, so that the scan reads no others: an array of structs, or a struct."""
    data = df.select(column).schema[0].dataType
    parts = [F.col(f"{column}.{n}").cast("array<string>" if isinstance(data, T.ArrayType) else "string").alias(n) for n in names]
    if isinstance(data, T.ArrayType):
        return F.arrays_zip(*parts)
    return F.struct(*parts)


def column_children(df: DataFrame, key: str, children: dict[str, tuple[str, str]], fields: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(kind, parent_id, pos, child_key) of nested columns, and the named fields as columns of text, in one scan.

    ``children`` maps a kind to (column, name of the key field); ``fields`` a kind to the scalars that its rows have
    beside.  Null columns, elements and keys and empty keys give no row; a struct is one child at 0.
    """
    fields = fields or {}
    more = list(dict.fromkeys(f for kind in children for f in fields.get(kind, ())))
    narrow = df.select(F.col(key).alias("parent_id"), *[narrowed(df, column, list(dict.fromkeys((name, *fields.get(kind, ()))))).alias(kind) for kind, (column, name) in children.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (kind, (_, name)) in enumerate(children.items(), 1):
                # All scalars of the ancestor, each with the same rows and ordinals: side by side they are its table.
                table, rows, ordinals = {}, np.empty(0, np.int64), ()
                for path, rows, ordinals, values in column_triples(batch.column(n), (kind,), np.arange(batch.num_rows)):
                    table[path[-1]] = values
                there = np.flatnonzero(pc.fill_null(pc.not_equal(table[name], ""), False).to_numpy(zero_copy_only=False))
                pos = ordinals[0][there] if ordinals else np.zeros(len(there), np.int64)
                at = pa.array(there)
                own = [table[f].take(at) if f in fields.get(kind, ()) else pa.nulls(len(there), pa.string()) for f in more]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(there), pa.string()), batch.column(0).take(pa.array(rows[there])), pa.array(pos, pa.int32()), table[name].take(at), *own], ["kind", "parent_id", "pos", "child_key", *(f"_{f}" for f in more)])

    schema = [T.StructField("kind", T.StringType()), T.StructField("parent_id", df.schema[key].dataType), T.StructField("pos", T.IntegerType())]
    flat = narrow.mapInArrow(run, T.StructType([*schema, T.StructField("child_key", T.StringType()), *(T.StructField(f"_{f}", T.StringType()) for f in more)]))
    return flat.select("kind", "parent_id", "pos", "child_key", *[F.col(f"_{f}").alias(f) for f in more])


#: What the review tables hold.
EVENT_CHILDREN = {"user": (("issue", "user"), "login", False), "assignee": (("issue", "assignees"), "login", False), "gh_label": (("issue", "labels"), "name", True)}
#: The fields of the children of raw events that their tables have as columns; ``json_children`` has all others, too.
_USER = ("id", "node_id", "avatar_url", "url", "type", "site_admin")
EVENT_FIELDS = {"user": _USER, "assignee": _USER, "gh_label": ("id", "color", "default", "description")}
REQUEST_CHILDREN = {"label": ("labels", "id"), "commit": ("last_commit", "id"), "commit_author": ("last_commit.author", "email")}


def review_children(events: DataFrame, requests: DataFrame) -> DataFrame:
    """(kind, parent_id, pos, child_key): the children of raw events and of merge requests."""
    columns = ("kind", "parent_id", "pos", "child_key")
    return json_children(events, "event_row", "payload", EVENT_CHILDREN).select(*columns).unionByName(column_children(requests, "mr_row", REQUEST_CHILDREN).select(*columns))


def review_child_table(events: DataFrame, requests: DataFrame, kind: str) -> DataFrame:
    """The children of one kind as a table: (parent_id, pos, child_key) and a column of text for each scalar field.

    Nested columns have their fields in the schema.  Raw events have those of EVENT_FIELDS; nested structs are children of
    their own kinds.
    """
    if kind in EVENT_CHILDREN:
        fields = EVENT_FIELDS[kind]
        children = json_children(events, "event_row", "payload", {kind: EVENT_CHILDREN[kind]}, fields)
        return children.select("parent_id", "pos", "child_key", *[F.col("fields")[f].alias(f) for f in fields])
    column, name = REQUEST_CHILDREN[kind]
    data = requests.select(column).schema[0].dataType
    element = data.elementType if isinstance(data, T.ArrayType) else data
    fields = tuple(f.name for f in element if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)))
    return column_children(requests, "mr_row", {kind: (column, name)}, {kind: fields}).drop("kind")
