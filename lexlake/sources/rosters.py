"""Rosters of judges from saved HTML pages, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import scalars as S

# Titles that stand before a name, longest first.
TITLES = ("Vice Chief Justice", "Chief Justice", "Associate Justice", "Chief Judge", "Presiding Judge", "Justice", "Judge")


def role_and_name(c: Column) -> dict[str, Column]:
    """The title before a name and the name."""
    text = S.collapse(c)
    pattern = "^(" + "|".join(TITLES) + r")\s+(.+)$"
    return {"role": F.regexp_extract(text, pattern, 1), "full_name": F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 2)).otherwise(text)}


def absolute(url: Column, base: str) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).when(F.startswith(url, F.lit("/")), F.concat(F.lit(base.rstrip("/")), url)).otherwise(url)


def links(pages: DataFrame, base: str, html: str = "html") -> DataFrame:
    """page_id, pos, url and text of the links of each page."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(tags).alias("pos", "tag"))
    return rows.select("page_id", "pos", absolute(F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1), base).alias("url"), S.strip_markup(F.col("tag")).alias("text"))


def headings(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, role, full_name, slug of the first heading of each page, as on biography pages."""
    head = S.strip_markup(F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    named = role_and_name(head)
    return pages.select("page_id", named["role"].alias("role"), named["full_name"].alias("full_name"), S.slugify(named["full_name"]).alias("slug"))
