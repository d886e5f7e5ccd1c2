"""Scalar text functions over comments, paths and addresses, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One step of the command scan: text without a slash, or a slash whose next characters cannot name a language.
_SKIP = r"(?sU)\G(?:[^/]+|/[^a-zA-Z].|/[a-zA-Z][^a-zA-Z]|/[a-zA-Z]{2}\S)"


def first_line(text: Column) -> Column:
    """The text without blanks around it, up to its first line end."""
    return F.regexp_extract(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), r"\A[^\r\n]*", 0)


def asks_for_review(text: Column) -> Column:
    """Whether the first line has the command, in any case; null text does not."""
    return F.coalesce(first_line(text).rlike("(?i)/review"), F.lit(False))


def language_code(text: Column) -> Column:
    """The first two-letter word after a slash in the first line, else empty; see _SKIP for what is passed over."""
    rest = F.regexp_replace(first_line(text), _SKIP, "")
    return F.coalesce(F.regexp_extract(rest, r"(?U)\A/([a-zA-Z]{2})(?:\s|\z)", 1), F.lit(""))


def number_of_request(url: Column) -> Column:
    """The number at the end of an address's path; 0 where there is none or a slash ends it."""
    last = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"[^/]*/?$", 0)
    return F.coalesce(last.try_cast("int"), F.lit(0))


def file_extension(path: Column) -> Column:
    """What follows the last dot of the whole path; empty without a dot, null for null."""
    return F.when(F.instr(path, ".") > 0, F.substring_index(path, ".", -1)).when(path.isNotNull(), "")


def chosen_path(new_path: Column, old_path: Column) -> Column:
    """The new path where it is not empty, else the old one, else null."""
    return F.coalesce(F.nullif(new_path, F.lit("")), F.nullif(old_path, F.lit("")))


def preview(text: Column, most: int = 128) -> Column:
    """The first line, at most so many characters; lines are not trimmed."""
    return F.substring(F.regexp_extract(text, r"\A[^\r\n]*", 0), 1, most)
