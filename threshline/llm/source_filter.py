"""Files that nobody wrote by hand: generated, minified, vendored, or data kept as source.

Paths are judged by repository attribute files.  Every ``.gitattributes`` among the rows declares rules for its directory
and below; for each attribute the last matching rule of the deepest directory wins, so a nearer file or a later line can
take a path out again.  For paths that nothing is declared of, CONVENTIONS stand in, rules of the same syntax.  Content is
judged by notices before the first code, by line shape (minified code) and by the share of literal rows (data).  From the
files shown so, patterns of paths and comments are mined (``mining``) and applied to the rest of the undeclared files.
An attribute file is read as far as its diff shows it: rules outside the shown hunks are not known.

Defined results: a null or empty path is judged by content alone, a null or empty diff by path alone, both absent is
hand-written; a deleted file is judged by the lines it had; repeated rows are each judged.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.llm.batches import slices
from threshline.llm.mining import mined, patterns, with_mined
from threshline.llm.notices import REMARK, has_notice
from threshline.operators.skew import join_by_frequency
from threshline.session import checkpointed

#: Attributes that declare a file as not hand-written.
ATTRIBUTES = ("linguist-generated", "linguist-vendored")
#: Public conventions of paths, in attribute-file syntax, for repositories that declare none.
CONVENTIONS = """
node_modules/** linguist-vendored
bower_components/** linguist-vendored
jspm_packages/** linguist-vendored
site-packages/** linguist-vendored
dist-packages/** linguist-vendored
Pods/** linguist-vendored
Carthage/** linguist-vendored
Godeps/** linguist-vendored
vendor/*/** linguist-vendored
external/*/** linguist-vendored
third_party/** linguist-vendored
third-party/** linguist-vendored
thirdparty/** linguist-vendored
ThirdParty/** linguist-vendored
3rdparty/** linguist-vendored
3rd_party/** linguist-vendored
3rd-party/** linguist-vendored
__generated__/** linguist-generated
obj/Debug/** linguist-generated
obj/Release/** linguist-generated
*.min.js linguist-generated
*.min.mjs linguist-generated
*.min.css linguist-generated
*.js.map linguist-generated
*.css.map linguist-generated
*.pb.go linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*.pb.gw.go linguist-generated
*_pb2.py linguist-generated
*_pb2.pyi linguist-generated
*_pb2_grpc.py linguist-generated
*_pb.js linguist-generated
*_pb.d.ts linguist-generated
*.generated.* linguist-generated
*.g.cs linguist-generated
*.g.i.cs linguist-generated
*.g.dart linguist-generated
*.freezed.dart linguist-generated
*.Designer.cs linguist-generated
*.designer.cs linguist-generated
*.AssemblyInfo.cs linguist-generated
*_generated.go linguist-generated
*_gen.go linguist-generated
zz_generated.* linguist-generated
package-lock.json linguist-generated
npm-shrinkwrap.json linguist-generated
yarn.lock linguist-generated
pnpm-lock.yaml linguist-generated
bun.lockb linguist-generated
deno.lock linguist-generated
composer.lock linguist-generated
Gemfile.lock linguist-generated
Cargo.lock linguist-generated
poetry.lock linguist-generated
pdm.lock linguist-generated
uv.lock linguist-generated
Pipfile.lock linguist-generated
Podfile.lock linguist-generated
packages.lock.json linguist-generated
project.assets.json linguist-generated
pubspec.lock linguist-generated
mix.lock linguist-generated
flake.lock linguist-generated
gradle.lockfile linguist-generated
go.sum linguist-generated
go.work.sum linguist-generated
paket.lock linguist-generated
Package.resolved linguist-generated
.terraform.lock.hcl linguist-generated
"""
#: Characters of attribute files that may be broadcast.
MOST_BROADCAST = 8_000_000
#: What names the files before the first hunk; a removed line of a comment may begin with the same signs later.
FILE_HEADER = re.compile(r"(?:(?:diff|index|similarity|rename|new file|deleted file|old mode|new mode)\b[^\n]*\n)*--- [^\n]*\n\+\+\+ [^\n]*(?:\n|\Z)")
ARMOR = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
NUMBER = r"-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[fFuUlL]*"
DATA_ROW = re.compile(
    rf"""\s*(?: [\[({{]?\s*(?:{NUMBER}\s*,\s*){{5,}}(?:{NUMBER})?\s*[\])}}]?\s*[,;]?
      | ["'][A-Za-z0-9+/=_-]{{40,}}["']\s*[,;+)\]}}]* | ["'](?:\\x[0-9a-fA-F]{{2}}|\\[0-7]{{3}}){{10,}}["']\s*[,;+)\]}}]* | [A-Za-z0-9+/]{{60,}}={{0,2}} )\s*$""",
    re.X,
)
#: Records of one shape after another on long lines: no statement ends, many quoted keys.
RECORD_KEY = re.compile(r'"[\w-]+"\s*:\s*')
SHORT_DATA = re.compile(rf"""\s*(?:["'][A-Za-z0-9+/=_-]{{8,}}["']|{NUMBER}(?:\s*,\s*{NUMBER})*)\s*[,;+)\]}}]*\s*$""")
#: Data has so many rows or characters at least, and this share of a file.
DATA_ROWS, DATA_CHARS, DATA_SHARE = 8, 1000, 0.8
#: A minified line is long and dense.
MIN_LINE, MIN_SHARE = 200, 0.7


def sides(diff: str) -> tuple[list[str], list[str]]:
    """(new lines, old lines) that a unified diff shows, without marks, file headers and carriage returns."""
    head = FILE_HEADER.match(diff)
    lines = diff[head.end() if head else 0 :].split("\n")
    new = [x[1:].rstrip("\r") for x in lines if x[:1] in ("+", " ")]
    old = [x[1:].rstrip("\r") for x in lines if x[:1] in ("-", " ")]
    return new, old


def content_lines(diff: str) -> list[str]:
    """The new lines, or the old ones where most of the file was taken out."""
    new, old = sides(diff)
    return new if sum(map(len, new)) >= sum(map(len, old)) else old


def _dense(line: str) -> bool:
    blanks = line.count(" ") + line.count("\t")
    signs = sum(map(line.count, "{}();,=:.&|[]<>"))
    return blanks <= 0.12 * len(line) and signs >= 0.12 * len(line)


def is_minified(lines: list[str]) -> bool:
    """Most characters stand on long lines of code without blanks."""
    total = sum(map(len, lines))
    dense = sum(len(x) for x in lines if len(x) >= MIN_LINE and _dense(x) and sum(map(x.count, ";{}")) >= len(x) // 100)
    return dense >= MIN_SHARE * total > 0


def is_data(lines: list[str]) -> bool:
    """Nearly all characters are rows of literals, more than a small table has, and not one literal alone."""
    body = [x for x in lines if x.strip() and (not REMARK.match(x) or DATA_ROW.match(x))]
    if any(ARMOR.search(x) for x in lines):
        return False
    total = sum(len(x.strip()) for x in body)
    rows = [x for x in body if DATA_ROW.match(x)]
    if rows and sum(len(x.strip()) for x in rows) >= DATA_SHARE * total:
        return len(rows) >= DATA_ROWS or total >= DATA_CHARS
    wide = [x for x in body if len(x) >= MIN_LINE]
    records = sum(len(x) for x in wide if len(RECORD_KEY.findall(x)) >= len(x) // 60)
    return records >= DATA_SHARE * total and total >= DATA_CHARS


@lru_cache(maxsize=4096)
def glob(pattern: str) -> tuple[re.Pattern, bool]:
    """(expression, whether it holds a slash) of an attribute pattern; ``**`` spans directories, ``*`` does not."""
    anchored = "/" in pattern.rstrip("/")
    body, k = "", 0
    text = pattern.lstrip("/")
    while k < len(text):
        if text.startswith("**/", k):
            body, k = body + "(?:[^/]+/)*", k + 3
        elif text.startswith("**", k):
            body, k = body + ".*", k + 2
        elif text[k] == "*":
            body, k = body + "[^/]*", k + 1
        elif text[k] == "?":
            body, k = body + "[^/]", k + 1
        elif text[k] == "[" and "]" in text[k + 2 :]:
            end = text.index("]", k + 2)
            body, k = body + fnmatch.translate(text[k : end + 1]).removeprefix("(?s:").rsplit(")", 1)[0], end + 1
        else:
            body, k = body + re.escape(text[k]), k + 1
    return re.compile(body + r"\Z", re.S), anchored


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(pattern, attribute, value) of each setting, in order; value None takes a setting back to undeclared."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "[attr]")):
            continue
        quoted = re.match(r'"((?:\\.|[^"\\])*)"\s+(.*)', line)
        pattern, rest = quoted.groups() if quoted else (line.split(None, 1) + [""])[:2]
        for word in rest.split():
            name, _, value = word.lstrip("-!").partition("=")
            if name in ATTRIBUTES and not pattern.startswith("!"):
                rules.append((pattern, name, None if word[0] == "!" else word[0] != "-" and value != "false"))
    return rules


def declared(path: str, files: list[tuple[str, list[tuple[str, str, bool | None]]]]) -> dict[str, bool]:
    """Per attribute, what the attribute files say of a path: (directory, rules) from the root down, the last match wins."""
    out: dict[str, bool | None] = {}
    for folder, rules in files:
        if folder and not path.startswith(folder + "/"):
            continue
        below = path[len(folder) + 1 :] if folder else path
        for pattern, name, value in rules:
            expression, anchored = glob(pattern)
            if expression.match(below) if anchored else expression.match(below.rpartition("/")[2]):
                out[name] = value
    return {k: v for k, v in out.items() if v is not None}


def conventional(path: str) -> bool:
    """Whether a rule of CONVENTIONS matches a path; one with a directory holds at any depth."""
    base = path.rpartition("/")[2]
    return any(e.search(path) if deep else e.match(base) for e, deep in _conventions())


@lru_cache(maxsize=1)
def _conventions() -> list[tuple[re.Pattern, bool]]:
    out = []
    for pattern, _, _ in parse_attributes(CONVENTIONS):
        expression, deep = glob(pattern)
        out.append((re.compile(r"(?:\A|/)" + expression.pattern) if deep else expression, deep))
    return out


def by_machine(path: str | None, diff: str | None, files: list[tuple[str, list]] = ()) -> bool:
    """Whether a file is shown to be no hand-written source: by what is declared for its path, else by convention or content."""
    return judged(path, diff, files)[0]


def judged(path: str | None, diff: str | None, files: list[tuple[str, list]] = ()) -> tuple[bool, bool, list[int]]:
    """(shown to be no hand-written source, declared to be it or not, codes of its patterns)."""
    new, old = sides(diff) if diff else ([], [])
    said = declared(path, files) if path and files else {}
    if said:
        return any(said.values()), True, patterns(path, (new, old))
    lines = new if sum(map(len, new)) >= sum(map(len, old)) else old
    shown = bool(path) and conventional(path) or has_notice(new) or has_notice(old) or is_minified(lines) or is_data(lines)
    return shown, False, patterns(path, (new, old))


def attribute_files(df: DataFrame) -> DataFrame:
    """(project_id, attribute_files): the latest version of every attribute file of a project, as [folder, text] from the root down.

    The path filter runs in the scan.  A project has one entry per directory that declares attributes, so a group holds
    what a repository has of such files, never its other rows.
    """
    path = F.col("new_path")
    mine = df.where((path == ".gitattributes") | path.endswith("/.gitattributes")).where(F.col("diff").isNotNull() & F.col("project_id").isNotNull())
    latest = Window.partitionBy("project_id", "new_path").orderBy(F.col("received_at").desc_nulls_last(), F.col("diff_id").desc())
    newest = mine.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    entry = F.struct(F.regexp_replace("new_path", r"/?\.gitattributes$", "").alias("folder"), F.col("diff").alias("text"))
    return newest.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("attribute_files"))


def machine_made(df: DataFrame) -> DataFrame:
    """(diff_id, by_machine) of every row of st_diff: one pass over the texts, then joins of the patterns' codes."""
    files = judged_files(df)
    more = with_mined(files, "_row", checkpointed(mined(files))).select("_row", F.lit(True).alias("_mined"))
    return files.select("_row", "diff_id", "shown").join(more, "_row", "left").select("diff_id", (F.col("shown") | F.coalesce("_mined", F.lit(False))).alias("by_machine"))


def machine_made_rows(df: DataFrame) -> DataFrame:
    """(diff_id) of the rows that ``machine_made`` marks: those shown at once and those a pattern speaks for, without a join of all."""
    files = judged_files(df)
    more = with_mined(files, "_row", checkpointed(mined(files)))
    return files.where("shown").select("diff_id").unionByName(more.select("diff_id"))


def judged_files(df: DataFrame) -> DataFrame:
    """(_row, diff_id, project, shown, declared, patterns) of every row, written once.

    The attribute files are written once and measured.  Up to MOST_BROADCAST characters they are broadcast; beyond that
    they meet the rows by project through a shuffle in which large projects are split.
    """
    files = checkpointed(attribute_files(df))
    chars = files.select(F.sum(F.aggregate("attribute_files", F.lit(0).cast("bigint"), lambda a, f: a + F.length(f["text"])))).first()[0] or 0
    rows = df.select("diff_id", "new_path", "diff", "project_id")
    if chars <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(files), "project_id", "left")
    else:
        counts = df.where("project_id IS NOT NULL").groupBy("project_id").agg(F.count("*").alias("_rows"))
        rows = join_by_frequency(rows, counts.join(files, "project_id"), "project_id", "_rows", F.col("diff_id"), "left")
    rows = rows.select("diff", "diff_id", "new_path", "project_id", "attribute_files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        n = TaskContext.get().partitionId() << 33
        for batch, start, texts in ((b, *s) for b in batches for s in slices(b.column(0))):
            ids, paths, projects, sets = (batch.column(k).slice(start, len(texts)) for k in (1, 2, 3, 4))
            results = []
            for text, path, files in zip(texts, paths.to_pylist(), sets.to_pylist()):
                rules = []
                for f in files or []:
                    if f["text"] not in parsed:
                        if len(parsed) > 10_000:
                            parsed.clear()
                        parsed[f["text"]] = parse_attributes("\n".join(content_lines(f["text"])))
                    rules.append((f["folder"], parsed[f["text"]]))
                results.append(judged(path, text, rules))
            shown, said, codes = (pa.array([r[k] for r in results], t) for k, t in enumerate((pa.bool_(), pa.bool_(), pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(texts)), pa.int64()), ids, projects, shown, said, codes], names)
            n += len(texts)

    names = ["_row", "diff_id", "project", "shown", "declared", "patterns"]
    kinds = (T.LongType(), df.schema["diff_id"].dataType, df.schema["project_id"].dataType, T.BooleanType(), T.BooleanType(), T.ArrayType(T.LongType()))
    # Written once: the patterns are counted over all files and then looked up, and neither reads a diff again.
    return checkpointed(rows.mapInArrow(run, T.StructType([T.StructField(c, k) for c, k in zip(names, kinds)])))
