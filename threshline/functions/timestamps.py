"""Texts of mixed form and zone as one instant in UTC, in plain Catalyst expressions.

An ordered cascade of anchored patterns rewrites each form into the same fields; the first pattern that matches decides,
and a text that none matches is no time.  Fields are then checked strictly: an impossible date or time is null, never
rolled over.  The zone is, in this order, an offset, a known abbreviation, a region name, the default of the row.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONE = r"((?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?"
_TIME = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_CLOCK12 = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_MONTH = r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
#: name, pattern, fields year|month|day|hour|minute|second|fraction|half of day|zone|bracketed region.
CASCADE = (
    ("iso", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:T|\s){_TIME}\s?{_ZONE}(?:\[([^\]]+)\])?$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?\s?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("year first", rf"(?i)^(\d{{4}})/(\d{{2}})/(\d{{2}})\s{_TIME}\s?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("dotted", rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s{_TIME}\s?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("slashed", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})\s{_CLOCK12}(?:\s?([AP]M))?\s?{_ZONE}$", None),
    ("mail", rf"(?i)^(?:[A-Z]{{3}}[a-z]*,\s)?(\d{{1,2}})\s{_MONTH}\s(\d{{4}})\s{_TIME}\s?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("month first", rf"(?i)^{_MONTH}\s(\d{{1,2}}),?\s(\d{{4}}),?\s{_CLOCK12}(?:\s?([AP]M))?\s?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("ideographs", r"^(\d{4})年(\d{1,2})月(\d{1,2})日\s?(\d{1,2})時(\d{1,2})分(?:(\d{1,2})秒)?$", "$1|$2|$3|$4|$5|$6||||"),
)
#: Usual offsets of abbreviated zones in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120,
    "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "PHT": 480, "ICT": 420, "WIB": 420, "PKT": 300, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "COT": -300, "BRT": -180, "ART": -180,
}
#: Bare numbers count in the unit that puts them in [2022, 2028): units a second, seconds of the bounds.
UNITS, EPOCH_BOUNDS = (1, 10**3, 10**6, 10**9), (1_640_995_200, 1_830_297_600)
DAY_US = 86_400_000_000


def regions() -> list[str]:
    """Region names of the zone database; a name beyond it is no zone."""
    return sorted(z for z in available_timezones() if "/" in z and not z.startswith(("posix/", "right/", "SystemV/")))


def trimmed(text: Column) -> Column:
    """Without blanks around, with single blanks inside and an ASCII minus."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, "−‐–", "---"), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def canonical(text: Column, date_order: Column) -> Column:
    """The fields of a trimmed text joined by bars, or null where no form fits."""
    out = None
    for name, pattern, fields in CASCADE:
        if name == "slashed":
            day_first = F.regexp_replace(text, pattern, "$3|$2|$1|$4|$5|$6|$7|$8|$9|")
            value = F.when(date_order == "mdy", F.regexp_replace(text, pattern, "$3|$1|$2|$4|$5|$6|$7|$8|$9|")).otherwise(day_first)
        else:
            value = F.regexp_replace(text, pattern, fields)
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def epoch_us(text: Column) -> Column:
    """Microseconds of a bare number in the one unit that puts it within the bounds."""
    number = F.when(text.rlike(r"^\d{9,19}$"), text.try_cast("decimal(20,0)"))
    low, high = EPOCH_BOUNDS
    out = None
    for unit in UNITS:
        us = (number * (10**6 // unit)).cast("bigint") if unit <= 10**6 else F.floor(number / (unit // 10**6)).cast("bigint")
        within = (number >= low * unit) & (number < high * unit)
        out = F.when(within, us) if out is None else out.when(within, us)
    return out


def local_to_utc(local_us: Column, zone: Column, ambiguous: str = "earlier", nonexistent: str = "forward") -> Column:
    """Microseconds UTC of a local time in a region.

    The offsets a day before and after give the two candidates; one that reads back as the local time is real.  A time
    that occurs twice has two, one that is skipped has none.  ``ambiguous``: earlier, later or null; ``nonexistent``:
    forward (moved by the length of the gap, that is, read with the offset before it) or null.
    """
    if ambiguous not in ("earlier", "later", "null") or nonexistent not in ("forward", "null"):
        raise ValueError("unknown policy")

    def read(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))

    def offset_at(us: Column) -> Column:
        utc = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone))
        return read(utc) - utc

    before, after = local_us - offset_at(local_us - DAY_US), local_us - offset_at(local_us + DAY_US)
    first, second = read(before) == local_us, read(after) == local_us
    both = {"earlier": F.least(before, after), "later": F.greatest(before, after), "null": F.lit(None).cast("bigint")}[ambiguous]
    none = before if nonexistent == "forward" else F.lit(None).cast("bigint")
    return F.when(before == after, before).when(first & second, both).when(first, before).when(second, after).otherwise(none)


def with_instant(df, text: str, out: str, default_zone: Column | None = None, date_order: Column | None = None, ambiguous: str = "earlier", nonexistent: str = "forward"):
    """``df`` with ``out``: microseconds UTC of the text column, null where it names no instant.

    Null, empty and odd texts, impossible dates or times, years 0 and 1, unknown zones, and local times without a default
    zone give null.  Digits beyond microseconds are cut off, absent seconds are zero.  Columns named _ts_* are reserved.
    """
    zone_of_row = F.lit(None).cast("string") if default_zone is None else default_zone
    order = F.lit("dmy") if date_order is None else F.coalesce(date_order, F.lit("dmy"))
    names = ", ".join(f"'{z}'" for z in regions())
    step = df.withColumns({"_ts_text": trimmed(F.col(text)), "_ts_order": order, "_ts_default": zone_of_row})
    step = step.withColumns({"_ts_fields": F.split(canonical(F.col("_ts_text"), F.col("_ts_order")), r"\|"), "_ts_epoch": epoch_us(F.col("_ts_text"))})
    field = lambda k: F.col("_ts_fields")[k]
    number = lambda k: field(k).try_cast("int")
    month = F.when(field(1).rlike("^[A-Za-z]"), ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(field(1), 1, 3))) + 2) / 3).cast("int")).otherwise(number(1))
    half = F.upper(field(7))
    hour = F.when(half == "", number(3)).when(number(3).between(1, 12), number(3) % 12 + F.when(half == "PM", 12).otherwise(0))
    second = F.coalesce(number(5), F.lit(0))
    micros = F.rpad(F.substring(field(6), 1, 6), 6, "0").try_cast("int")
    valid = (number(0) > 1) & hour.between(0, 23) & number(4).between(0, 59) & second.between(0, 59)
    made = F.unix_micros(F.try_make_timestamp(number(0), month, number(2), hour, number(4), second.cast("decimal(16,6)"), F.lit("UTC")))
    step = step.withColumns({"_ts_local": F.when(valid, made + F.coalesce(micros, F.lit(0))), "_ts_zone": field(8), "_ts_region": F.when(field(9) != "", field(9)).when(field(8).contains("/"), field(8))})
    zone = F.col("_ts_zone")
    bare = F.regexp_replace(zone, r"(?i)^(?:UTC|GMT)(?=[+-])", "")
    digits = F.regexp_replace(bare, r"[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    numeric = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(bare.startswith("-"), -1).otherwise(1))
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    step = step.withColumns({
        "_ts_offset": F.when(bare.rlike(r"^[+-]\d{2}:?(?:\d{2})?$"), numeric).otherwise(known[F.upper(zone)]),
        "_ts_in": F.when(F.col("_ts_region").isNotNull(), F.expr(f"CASE WHEN _ts_region IN ({names}) THEN _ts_region END")).when(zone == "", F.expr(f"CASE WHEN _ts_default IN ({names}) THEN _ts_default END")),
    })
    local = F.col("_ts_local")
    instant = (
        F.when(F.col("_ts_epoch").isNotNull(), F.col("_ts_epoch"))
        .when(F.col("_ts_offset").isNotNull(), local - F.col("_ts_offset").cast("bigint") * 60_000_000)
        .when(F.col("_ts_in").isNotNull(), local_to_utc(local, F.col("_ts_in"), ambiguous, nonexistent))
    )
    # Exploding one value keeps its filters above: pushed below, they would repeat the whole cascade for each use of a field.
    return step.withColumn(out, F.explode(F.array(instant))).drop("_ts_text", "_ts_order", "_ts_default", "_ts_fields", "_ts_epoch", "_ts_local", "_ts_zone", "_ts_region", "_ts_offset", "_ts_in")
