"""Patterns mined from files that show what they are, and applied to files of repositories that declare nothing.

A pattern is a glob in attribute-file syntax (a directory, a name, an ending) or a comment before the first code with one
word left open.  Every file gives its patterns with whether it was shown to be machine-made on its own.  A pattern that
holds for enough files of enough projects, nearly all of them machine-made, speaks for the rest of its files.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshline.llm.notices import head
from threshline.operators.skew import join_by_frequency

#: A pattern needs so many files, so many projects (of 64 classes of them), and this share shown by themselves.
FILES, PROJECTS, SHARE = 8, 4, 0.9
#: Patterns that may be broadcast, 8 bytes each.
MOST_BROADCAST = 500_000
WORD = re.compile(r"[\x21-\x7e]+|[^\x00-\x7f\s]+")
#: A word that names one thing: it has a digit, a sign inside or a change of case.
NAME = re.compile(r"[^\W\d_]*(?:\d|[^\W_]_|\w[./\\`-]\w|[a-z][A-Z])")
_BITS = (1 << 64) - 1


def path_patterns(path: str) -> list[str]:
    """Globs that the path matches: its directories, its name, and the endings of a name with two dots or an underscore."""
    *folders, name = path.split("/")
    out = [f"{f}/**" for f in dict.fromkeys(folders) if f]
    out.append(name)
    stem, dot, _ = name.partition(".")
    if name.count(".") > 1:
        out.append("*" + name[len(stem) :])
    if dot and "_" in stem:
        out.append("*" + name[stem.rindex("_") :])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def comment_patterns(text: str) -> list[int]:
    """Codes of the comment with each of its words left open in turn, and as it stands; names are open always."""
    words = [None if NAME.match(w) else w.strip(".,;:!()").lower() for w in WORD.findall(text)]
    said = [w for w in words if w]
    if len(said) < 2 or sum(map(len, said)) < 12:
        return []
    codes = [xxhash.xxh64_intdigest(w or "", k) for k, w in enumerate(words)]
    total = sum(codes)
    opened = {(total - c + xxhash.xxh64_intdigest("", k)) & _BITS for k, (c, w) in enumerate(zip(codes, words)) if w}
    return [_signed(c) for c in sorted(opened | {total & _BITS})]


def patterns(path: str | None, sides: tuple[list[str], ...]) -> list[int]:
    """Codes of all patterns of a file, each once."""
    out = {_signed(xxhash.xxh64_intdigest("/" + p)) for p in path_patterns(path)} if path else set()
    for lines in sides:
        for text in dict.fromkeys(head(lines)):
            out.update(comment_patterns(text))
    return sorted(out)


def mined(files: DataFrame, files_needed: int = FILES, projects_needed: int = PROJECTS, share: float = SHARE, every: bool = False) -> DataFrame:
    """(pattern, n) of those that hold; unless ``every``, only those with files that aren't shown yet, as others change nothing.

    ``files``: (patterns, shown, project).  One aggregate with map-side combine; projects are counted in a bit set.
    """
    seen = files.select(F.explode("patterns").alias("pattern"), F.col("shown").cast("int").alias("shown"), F.expr("shiftleft(1L, CAST(pmod(xxhash64(project), 64) AS INT))").alias("bit"))
    per = seen.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("shown").alias("shown"), F.bit_or("bit").alias("bits"))
    adding = F.lit(True) if every else F.col("shown") < F.col("n")
    return per.where((F.col("n") >= files_needed) & adding & (F.col("shown") >= share * F.col("n")) & (F.bit_count("bits") >= projects_needed)).select("pattern", "n")


def with_mined(files: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """(row, diff_id): files not shown yet and not declared that a mined pattern speaks for."""
    wanted = files.where("NOT shown AND NOT declared").select(row, "diff_id", F.explode("patterns").alias("pattern"))
    if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        hit = wanted.join(F.broadcast(found.select("pattern")), "pattern")
    else:
        hit = join_by_frequency(wanted, found, "pattern", "n", F.col(row))
    return hit.select(row, "diff_id").distinct()


def held_out(files: DataFrame) -> DataFrame:
    """One row that measures mining: patterns are mined in half of the projects and tried on the files of the other half.

    (n_shown, n_found, n_other, n_wrong): files shown to be machine-made and how many of them the patterns alone find, files
    not shown and how many of those the patterns find.
    """
    half = F.pmod(F.xxhash64("project", F.lit(1)), F.lit(2)) == 0
    learned = mined(files.where(half), every=True).select("pattern")
    tried = files.where(~half & ~F.col("declared"))
    hit = tried.select("_row", F.explode("patterns").alias("pattern")).join(learned, "pattern").select("_row", F.lit(True).alias("hit")).distinct()
    both = tried.join(hit, "_row", "left").select("shown", F.coalesce("hit", F.lit(False)).alias("hit"))
    return both.agg(*[F.count_if(c).alias(n) for n, c in (("n_shown", F.col("shown")), ("n_found", F.col("shown") & F.col("hit")), ("n_other", ~F.col("shown")), ("n_wrong", ~F.col("shown") & F.col("hit")))])
