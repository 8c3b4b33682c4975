"""What a parser found in each text, kept as semi-structured rows: which fields are missing, by path, and what goes back into the opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlake.functions import scalars as S

# The fields whose absence is noted, and those that fill empty fields of an opinion (name in what was parsed, name in the opinion).
TRACKED = ("case_number", "case_name", "release_date", "is_precedential", "disposition", "author")
FILLED = (("case_number", "case_number"), ("case_name", "title"), ("reporter_cite", "reporter_cite"), ("release_date", "release_date"), ("disposition", "disposition"))


def blank_at(extracted: Column, path: str) -> Column:
    """Whether a VARIANT has nothing at a path: no such path, null, an empty text or an empty list."""
    text = F.try_variant_get(extracted, path, "string")
    return F.coalesce(text.isin("", "[]"), F.lit(True))


def missing_fields(extracted: Column, fields: tuple[str, ...] = TRACKED) -> Column:
    return F.filter(F.array(*[F.when(blank_at(extracted, f"$.{f}"), F.lit(f)) for f in fields]), lambda f: f.isNotNull())


def log_rows(parsed: DataFrame, text_sha: str, state: str, version: str, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """opinion_id, parser_state, parser_version, extracted (VARIANT), missing_fields, raw_text_sha256: a row for each text of ``parsed`` (opinion_id, json). JSON that does not
    read leaves everything missing."""
    own = parsed.select("opinion_id", F.col(state).alias("parser_state"), F.lit(version).alias("parser_version"), F.try_parse_json("json").alias("extracted"), F.col(text_sha).alias("raw_text_sha256"))
    return own.withColumn("missing_fields", missing_fields(F.col("extracted"), fields))


def fresh_logs(logs: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows for texts that the parser of the state has not seen."""
    return logs.join(existing.select("opinion_id", "parser_state", "raw_text_sha256"), ["opinion_id", "parser_state", "raw_text_sha256"], "left_anti")


def completeness(logs: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """parser_state, parser_version, field, texts, found, percent: how often each field is found, by parser; versions stand beside each other, so that a step back shows."""
    rows = logs.select("parser_state", "parser_version", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (~F.array_contains("missing_fields", f)).alias("found")) for f in fields])).alias("x"))
    by = rows.groupBy("parser_state", "parser_version", F.col("x.field").alias("field")).agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(F.col("x.found"), 1)).alias("found"))
    return by.withColumn("percent", S.percent(F.col("found"), F.col("texts")))


def schema_of_all(logs: DataFrame, by: str = "parser_state") -> DataFrame:
    """The merged schema of what each parser wrote."""
    return logs.groupBy(by).agg(F.schema_of_variant_agg("extracted").alias("shape"))


def filled_opinions(opinions: DataFrame, logs: DataFrame, bucket: bool = True) -> DataFrame:
    """Opinions with empty fields filled from their logs (one row an opinion). An outcome that comes in brings its class; and that a text says it is not precedential
    counts over the default that it is (a text that says nothing, or yes, changes nothing)."""
    get = lambda path, kind: F.try_variant_get("extracted", f"$.{path}", kind)
    own = logs.select(F.col("opinion_id").alias("id"), *[get(p, "string").alias(f"#{c}") for p, c in FILLED], get("is_precedential", "boolean").alias("#precedential"))
    rows = opinions.join(own, "id", "left")
    empty = lambda c: S.text_or_blank(F.col(c).cast("string")) == ""
    kinds = dict(opinions.dtypes)
    out = {c: F.when(empty(c) & (S.text_or_blank(F.col(f"#{c}")) != ""), F.col(f"#{c}").try_cast(kinds[c])).otherwise(F.col(c)) for _, c in FILLED if c in kinds}
    if bucket and "disposition_bucket" in kinds:
        came = empty("disposition") & (S.text_or_blank(F.col("#disposition")) != "")
        out["disposition_bucket"] = F.when(came, S.disposition_bucket(F.col("#disposition"))).otherwise(F.col("disposition_bucket"))
    out["is_precedential"] = F.col("is_precedential") & F.coalesce(F.col("#precedential"), F.lit(True))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in opinions.columns])
