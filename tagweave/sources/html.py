"""Sections of HTML pages, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.functions.scalars import strip_html

_HEADING = r"(?is)<h([1-3])\b[^>]*>(.*?)</h\1>"


def headings(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, heading) of h1 to h3, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return df.select(key, F.posexplode(found).alias("pos", "heading")).withColumn("heading", strip_html(F.col("heading")))


def sections(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, heading, body, paragraphs, items, code): a section runs from its heading
    to the next one."""
    cut = F.slice(F.split(html, r"(?i)(?=<h[1-3]\b)"), 2, 1 << 20)
    each = df.select(key, F.posexplode(cut).alias("pos", "__part"))
    return each.select(
        key, "pos", strip_html(F.regexp_extract("__part", _HEADING, 2)).alias("heading"),
        strip_html(F.regexp_replace("__part", _HEADING, " ")).alias("body"),
        F.size(F.regexp_extract_all("__part", F.lit(r"(?i)<p\b"), F.lit(0))).alias("paragraphs"),
        F.transform(F.regexp_extract_all("__part", F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)), strip_html).alias("items"),
        F.regexp_extract_all("__part", F.lit(r"(?is)<(?:pre|code)\b[^>]*>(.*?)</(?:pre|code)>"), F.lit(1)).alias("code"),
    )
