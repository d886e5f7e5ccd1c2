import pytest

from threshline.llm.mining import held_out
from threshline.llm.source_filter import by_machine, conventional, declared, judged_files, machine_made, machine_made_rows, parse_attributes

CODE = "@@ -0,0 +1,3 @@\n+def total(rows):\n+    return sum(rows)\n+\n"
MADE = [
    ("a/node_modules/x/i.js", CODE), ("lib/vendor/pkg-a/x.go", CODE), ("x.min.js", None), ("api/a.pb.go", CODE), ("yarn.lock", None), ("a_pb2.py", ""), ("src/__generated__/x.ts", CODE),
    ("x.go", "+// Code generated by toolc. DO NOT EDIT.\n" + CODE), (None, "+# AUTOGENERATED FILE - changes will be overwritten\n" + CODE), ("x.c", "+// Upstream: Lib 1.2.3, file copied unchanged.\n" + CODE), ("x.c", "+// (c) 2019 the Lib contributors, released under a permissive licence\n" + CODE),
    ("x.sql", "--- a/x.sql\n+++ b/x.sql\n@@ -1,2 +0,0 @@\n--- Code generated by toolc. DO NOT EDIT.\n-select 1;\n"), ("x.sql", "@@ -1,2 +0,0 @@\n--- Machine-written by toolc; rerun the build instead of editing.\n-select 1;\n"),
    ("x.js", "+" + "function a(b,c){return b.d(c,1)}for(var e=0;e<9;e++)f[e]&&f[e].g();" * 8), ("t.py", "+x = [\n" + "+0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08,\n" * 30 + "+]"), ("old.js", "-" + "var a=b[1]||{};c=>{d.e(c);return!0};" * 12),
]
HAND = [
    ("src/vendors/x.py", CODE), ("app/vendor_portal/x.py", CODE), ("src/minify/x.py", CODE), ("tools/generators/x.py", CODE), ("core/generated_reports/x.py", CODE), ("lock_file_reader.py", CODE), (None, None), ("", ""), ("x.py", None),
    ("x.go", "+// Writes the auto-generated page files; do not edit those, edit this one.\n" + CODE), ("x.go", "+// Written by hand; the old generated version was removed.\n" + CODE), ("x.c", "+// Copyright (c) 2025 lumid team. All rights reserved.\n" + CODE), ("x.c", "+// The mesh id is generated by join, see below.\n" + CODE), ("x.c", '+  emit("// Code generated by x. DO NOT EDIT.");\n' + CODE),
    ("x.py", CODE + "+T = [\n+  1, 2, 3, 4, 5, 6, 7,\n+]\n" + CODE * 3), ("x.py", '+query = "' + "select some words and more words " * 20 + '"\n' + CODE), ("k.py", "+-----BEGIN CERTIFICATE-----\n" + ("+" + "Ab1" * 21 + "x\n") * 12 + "+-----END CERTIFICATE-----"),
]


@pytest.mark.parametrize("path,diff", MADE)
def test_made(path, diff):
    assert by_machine(path, diff)


@pytest.mark.parametrize("path,diff", HAND)
def test_by_hand(path, diff):
    assert not by_machine(path, diff)


LICENCE = ["Licensed under terms that are told at length."] * 20
NOTICE = "Code generated by toolc. DO NOT EDIT."


def test_notice_below_a_long_licence():
    shown = lambda lines: "".join(f"+{x}\n" for x in lines)
    assert by_machine("x.go", shown(["// " + x for x in LICENCE] + ["", "// " + NOTICE]) + CODE)
    assert by_machine("x.c", shown(["/*", *LICENCE, "*/", "// " + NOTICE]) + CODE)
    assert not by_machine("x.c", shown(["// " + x for x in LICENCE] + ["int a;", "// " + NOTICE]) + CODE)
    assert not by_machine("x.h", shown(["#define A 1"] * 20 + ["// " + NOTICE]) + CODE)


def test_precedence():
    files = [("", parse_attributes("# c\n*.js linguist-generated\n/docs/** linguist-vendored=true\n*.js -linguist-generated\ngen/*.py linguist-generated")), ("lib", parse_attributes('*.js linguist-generated\n"a b.js" linguist-generated=false'))]
    said = lambda p: declared(p, files)
    assert said("x.js") == {"linguist-generated": False} and said("lib/sub/x.js") == {"linguist-generated": True}
    assert said("lib/a b.js") == {"linguist-generated": False} and said("docs/a/b.md") == {"linguist-vendored": True}
    assert said("a/docs/b.md") == {} and said("gen/x.py") == {"linguist-generated": True} and said("a/gen/x.py") == {}
    assert said("gen/sub/x.py") == {} and said("lib2/x.js") == {"linguist-generated": False}
    assert declared("a", [("", parse_attributes("a linguist-generated\na !linguist-generated"))]) == {}


def test_declaration_beats_conventions():
    assert not by_machine("vendor/a/x.js", CODE, [("", parse_attributes("vendor/** -linguist-vendored"))])
    assert conventional("vendor/a/x.js") and not conventional("vendor/x.js")


@pytest.mark.parametrize("most", [10**7, -1])
def test_table(spark, monkeypatch, most):
    monkeypatch.setattr("threshline.llm.source_filter.MOST_BROADCAST", most)
    schema = "diff_id LONG, new_path STRING, diff STRING, project_id INT, received_at STRING, by_machine STRING"
    rows = [
        (1, ".gitattributes", "@@ -0,0 +1 @@\n+*.py linguist-generated", 1, "1", ""), (2, ".gitattributes", "+*.py linguist-generated=false\n+*.sql linguist-generated", 1, "2", ""), (3, "a.sql", CODE, 1, "1", ""), (4, "a.py", CODE, 1, "1", ""),
        (5, "a.sql", CODE, 2, "1", ""), (6, None, None, None, None, None), (7, "x.min.js", None, None, "1", ""), (7, "x.min.js", None, None, "1", ""),
    ]
    got = machine_made(spark.createDataFrame(rows, schema)).where("by_machine").collect()
    assert sorted(r.diff_id for r in got) == [3, 7, 7]
    assert machine_made(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("text", [
    "toolgen 4.1: transcription of a.idl, renewed by every nightly build", "Generado por toolc; no editar a mano", "Bu: dosya", "由 toolc 自动生成，请勿手动修改", "toolc가 자동 생성한 파일입니다. 수정하지 마십시오", "Wygenerowano przez toolc, nie edytować",
    "Rendered from page.tmpl, do not change by hand", "Diese Datei wurde von toolc erzeugt", "Generato da toolc - non modificare",
])
def test_notices_by_parts(text):
    assert by_machine("x.c", f"+// {text}\n" + CODE) == (text != "Bu: dosya")


@pytest.mark.parametrize("text", ["Do not change the order of these steps.", "The output of page.tmpl is checked below", "Maintained by hand since the generated one was lost, do not edit", "Emits the generated pages; never edit them", "The limits are derived from the load test, do not change this without a new run", "Rows created by older versions will be replaced", "Nicht vergessen: hier wird nichts erzeugt"])
def test_no_notices(text):
    assert not by_machine("x.c", f"+// {text}\n" + CODE)


@pytest.mark.parametrize("most", [10**6, -1])
def test_mined_patterns_apply_to_the_rest(spark, monkeypatch, most):
    monkeypatch.setattr("threshline.llm.mining.MOST_BROADCAST", most)
    schema = "diff_id LONG, new_path STRING, diff STRING, project_id INT, received_at STRING"
    minified = "+" + "function a(b,c){return b.d(c,1)}for(var e=0;e<9;e++)f[e]&&f[e].g();" * 8
    rows = [(k, f"assets{k}/packed/p{k}.js", minified, k % 6, "1") for k in range(20)] + [(100, "lib/packed/small.js", CODE, 9, "1"), (101, "lib/packing/small.js", CODE, 9, "1")]
    rows += [(200 + k, f"m{k}.go", f"+// Code generated by tool{k}x. DO NOT EDIT.\n+// Kept in step with the schema of its service, {k}\n" + CODE, k % 6, "1") for k in range(12)]
    rows += [(300, "n.go", "+// Kept in step with the schema of its service, 77\n" + CODE, 8, "1"), (301, "n.go", "+// Kept in mind\n" + CODE, 8, "1")]
    rows += [(400, ".gitattributes", "+packed/** -linguist-generated\n+lib/packed/** -linguist-generated", 10, "1"), (401, "lib/packed/small.js", CODE, 10, "1")]
    got = {r.diff_id for r in machine_made(spark.createDataFrame(rows, schema)).where("by_machine").collect()}
    assert sorted(got) == sorted(r.diff_id for r in machine_made_rows(spark.createDataFrame(rows, schema)).collect())
    assert got == {*range(20), *range(200, 212), 100, 300}


def test_mining_on_held_out_projects(spark):
    minified = "+" + "function a(b,c){return b.d(c,1)}for(var e=0;e<9;e++)f[e]&&f[e].g();" * 8
    rows = [(k, f"assets{k}/packed/p{k}.js", minified, k, "1") for k in range(60)] + [(100 + k, f"src{k}/a{k}.js", CODE, k, "1") for k in range(60)]
    measured = held_out(judged_files(spark.createDataFrame(rows, "diff_id LONG, new_path STRING, diff STRING, project_id INT, received_at STRING"))).first()
    assert measured.n_found == measured.n_shown > 15 and measured.n_other > 15 and measured.n_wrong == 0
