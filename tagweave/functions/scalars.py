"""Scalar functions: numbers, strings, dates. All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cooling_degrees(mean: Column, base: float) -> Column:
    return F.greatest(mean - base, F.lit(0.0))


def heating_degrees(mean: Column, base: float) -> Column:
    return F.greatest(F.lit(base) - mean, F.lit(0.0))


def reset(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between (x0, y0) and (x1, y1), level outside."""
    slope = (y1 - y0) / (x1 - x0)
    return F.when(x <= x0, F.lit(y0)).when(x >= x1, F.lit(y1)).otherwise(y0 + (x - x0) * slope)


#: Pounds per unit of mass (fixed values).
POUNDS = {"lbs": 1.0, "kg": 2.20462, "tons": 2000.0, "metric": 2204.62}


def emissions(energy: Column, pounds_per_unit: float, unit: str = "kg") -> Column:
    return energy * pounds_per_unit / POUNDS[unit]


def half_up(x: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x + 0.5)


def uri_parts(uri: Column) -> dict[str, Column]:
    return {p.lower(): F.try_parse_url(uri, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH", "QUERY", "REF")}


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, entities are decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return collapse(decode_entities(F.regexp_replace(bare, r"<[^>]*>", " ")))


def decode_entities(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Words that put a function into a category, first match first (fixed values).
CATEGORY_WORDS: dict[str, Sequence[str]] = {
    "hvac": ("hvac", "ahu", "vav", "cooling", "heating", "airside"),
    "energy": ("energy", "kwh", "kw", "consumption", "demand"),
    "meter": ("meter", "metering"),
    "spark_analysis": ("spark", "fault", "alarm"),
    "reporting": ("report", "email", "summary"),
    "admin": ("admin", "job", "monitor"),
    "sensor": ("sensor", "temp", "pressure"),
    "control": ("control", "setpoint", "cmd"),
    "data_analysis": ("his", "data", "analysis"),
    "utilities": ("util", "helper", "tool"),
}


def categorize(text: Column, rules: dict[str, Sequence[str]] | None = None, default: str = "uncategorized") -> Column:
    out = None
    for name, words in (rules or CATEGORY_WORDS).items():
        test = F.lit(False)
        for word in words:
            test = test | F.contains(F.lower(text), F.lit(word))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def tokens(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9 of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))


def prefixes(token: Column) -> Column:
    """The token and its proper prefixes of two characters or more."""
    return F.transform(F.sequence(F.lit(2), F.length(token)), lambda n: F.substring(token, F.lit(1), n))


#: Keywords that each open one more path through code (fixed values).
BRANCH_WORDS = ("if", "else", "each", "while", "for", "catch", "and", "or")


def complexity(source: Column) -> Column:
    return 1 + F.regexp_count(source, F.lit(r"\b(" + "|".join(BRANCH_WORDS) + r")\b"))


def lines_of_code(source: Column) -> Column:
    return F.size(F.filter(F.split(source, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("//")))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 3.6e9


def is_approximate(a: Column, b: Column, share: float = 0.001) -> Column:
    """Whether two numbers differ by no more than a share of the smaller one."""
    return (a == b) | (F.abs(a - b) <= F.least(F.abs(a), F.abs(b)) * share)
