"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_MICROS = 7 * 86_400 * 1_000_000
DAY_MICROS = 86_400 * 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start: str | Column, end: str | Column) -> Column:
    """Whole microseconds from ``start`` to ``end``; works on time-zone-free timestamps."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(1e6)


def floor_units(micros: Column, unit: int) -> Column:
    """Integer floor division, exact for negative values too."""
    return ((micros - F.pmod(micros, F.lit(unit))) / F.lit(unit)).cast("long")


def days_after(ts: str | Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), col(ts))


def parse_timestamp(c: str | Column) -> Column:
    """Unreadable text becomes null instead of failing the job."""
    return col(c).try_cast("timestamp_ntz")


def truthy(c: str | Column) -> Column:
    """'False' in any case, the empty text and null are false, everything else is true."""
    text = F.lower(col(c).cast("string"))
    return F.when(text.isNull() | text.isin("false", ""), F.lit(False)).otherwise(F.lit(True))


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """Null where the denominator is zero or null."""
    return col(numerator).cast("double") / F.nullif(col(denominator).cast("double"), F.lit(0.0))


def rate(condition: Column) -> Column:
    """Share of rows where the condition holds (aggregate)."""
    return F.avg(condition.cast("int"))


def monday_of(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def in_summer(ts: str | Column) -> Column:
    return F.coalesce(F.month(col(ts)).isin(7, 8), F.lit(False))


def overlaps_summer(start: str | Column, end: str | Column) -> Column:
    """Does [start, end] meet [1 July 00:00, 31 August 00:00] of any year it spans? Null bounds give false.

    Within one year both ends decide; an interval into a later year misses the summer only if it starts after one
    and ends before the next.
    """
    start, end = col(start), col(end)
    years = F.year(end) - F.year(start)
    midnight = F.to_date(start).cast("timestamp_ntz") == start
    last_day = (F.month(start) == 8) & ((F.day(start) < 31) | midnight)
    starts_before = (F.month(start) < 8) | last_day
    ends_after = F.month(end) >= 7
    same_year = (years == 0) & starts_before & ends_after
    return F.coalesce(same_year | ((years > 0) & (starts_before | ends_after)) | (years > 1), F.lit(False))


# Token lists and labels of the school categories, first match wins.
SCHOOL_TYPES = [
    ("Academic", ("gym", "passerelle")),
    ("Secondary", ("sek", "secondary")),
    ("Vocational", ("bm", "efz", "wms")),
]
SCHOOL_TYPES_OLD = [
    ("Academic", ("gymnasium", "lycee", "liceo", "matura", "maturitat", "passerelle")),
    ("Vocational", ("bme", "fm", "fms", "fachmatur", "apprentice")),
    ("Secondary", ("sekundar", "realschule", "klasse")),
]
EDUCATION_OLD = [
    (
        "Primary_LowerSec",
        ("1. klasse", "2. klasse", "3. klasse", "4. klasse", "5. klasse", "6. klasse", "7. klasse", "primaire"),
    ),
    ("Secondary", ("gymnasium", "lycee", "liceo", "matura", "maturitat", "hms", "ims", "isme", "passerelle")),
    ("Tertiary_Apprentice", ("bme", "fm", "fms", "fachmatur", "apprentice")),
]


def first_token_match(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: str | Column) -> Column:
    """Label of the first table row with a token contained in ``text``."""
    out = default if isinstance(default, Column) else F.lit(default)
    for label, tokens in reversed(table):
        hit = text.contains(tokens[0])
        for token in tokens[1:]:
            hit = hit | text.contains(token)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def school_type_category(school: str | Column) -> Column:
    text = F.lower(col(school))
    unknown = text.isNull() | text.isin("unknown", "nan", "none")
    return F.when(unknown, F.lit("Unknown")).otherwise(first_token_match(text, SCHOOL_TYPES, "Other"))


def school_type_category_old(school: str | Column) -> Column:
    text = F.coalesce(F.lower(col(school)), F.lit("nan"))
    rest = F.when(text.isin("unknown", "keine angabe"), F.lit("Unknown")).otherwise(F.lit("Other"))
    return first_token_match(text, SCHOOL_TYPES_OLD, rest)


def education_level(class_year: str | Column) -> Column:
    year = col(class_year)
    return (
        F.when(year.isNull() | (year == 0), F.lit("Unknown"))
        .when(year <= 2, F.lit("Lower secondary"))
        .when(year <= 4, F.lit("Upper secondary"))
        .otherwise(F.lit("Other"))
    )


def education_level_old(school: str | Column) -> Column:
    return first_token_match(F.coalesce(F.lower(col(school)), F.lit("")), EDUCATION_OLD, "Unknown")
