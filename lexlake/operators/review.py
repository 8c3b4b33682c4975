"""What reviewers see and do: triage of dates and bodies, slices of suggestions, acceptance in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import scalars as S


def date_sanity(released: Column, ref_date: Column) -> Column:
    """pre_1849, pre_1900 or future; null for a date that may be right."""
    return F.when(released < F.lit("1849-01-01").cast("date"), "pre_1849").when(released < F.lit("1900-01-01").cast("date"), "pre_1900").when(released > ref_date, "future")


def flag_misdated(opinions: DataFrame) -> DataFrame:
    """``review_status`` becomes flagged where the date is before 1849."""
    return opinions.withColumn("review_status", F.when(F.col("release_date") < F.lit("1849-01-01").cast("date"), "flagged").otherwise(F.col("review_status")))


def with_body(opinions: DataFrame, body: bool = True) -> DataFrame:
    """Opinions with a text, or those without."""
    blank = S.text_or_blank(F.col("raw_text")) == ""
    return opinions.where(~blank if body else blank)


def suggestion_slice(suggestions: DataFrame, opinions: DataFrame, courts: DataFrame, tag: str = "", category: str = "", state: str = "", min_confidence: str = "") -> DataFrame:
    """Suggestions (opinion_id, tag, category, confidence, status) that fit every filter that is given; a confidence that is no number is ignored."""
    rows = suggestions
    for name, value in (("tag", tag.strip()), ("category", category.strip())):
        rows = rows.where(F.col(name) == value) if value else rows
    if state.strip():
        own = opinions.select(F.col("id").alias("opinion_id"), "court_id").join(courts.where(F.col("state_code") == state.strip().upper()).select(F.col("id").alias("court_id")), "court_id", "left_semi")
        rows = rows.join(own, "opinion_id", "left_semi")
    least = F.try_to_number(F.lit(min_confidence.strip() or "x"), F.lit("9999.999999"))
    return rows.where(least.isNull() | (F.col("confidence") >= least))


def slice_totals(rows: DataFrame) -> DataFrame:
    """Number and mean confidence of a slice by status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def accept(suggestions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pending suggestions that are in ``chosen`` (opinion_id, tag) become applied; nothing else changes."""
    marks = chosen.select("opinion_id", "tag").distinct().withColumn("chosen", F.lit(True))
    rows = suggestions.join(marks, ["opinion_id", "tag"], "left")
    return rows.withColumn("status", F.when(F.col("chosen") & (F.col("status") == "pending"), "applied").otherwise(F.col("status"))).select(*suggestions.columns)
