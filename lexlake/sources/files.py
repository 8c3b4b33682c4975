"""Readers and writers of the external files. Schemas are always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlake.operators.stored import fresh_dir, store

CORRUPT = "_corrupt_record"


def bulk_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""The raw dump: "\" escapes, quotes are not doubled, fields hold line breaks (so a file is one task: for large dumps see ``split_csv``),
    bz2 is read as it is. Rows that do not read are kept in a column, to be counted and left out by ``valid``."""
    return spark.read.schema(f"{schema}, {CORRUPT} STRING").options(header=True, multiLine=True, quote='"', escape="\\", mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True).csv(path)


def split_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    r"""The raw dump like ``bulk_csv``, for files of any size and any number of them, each with a header: lines are read in splits (bz2 too), and a record goes
    on where the quotes before a line, counted over all lines of its file in the order of its splits, are odd. A character after "\" counts for nothing. Rows that
    do not read are kept in the same column."""
    at = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    folder = fresh_dir(spark, "dump-lines")
    lines = store(lines.withColumn("quotes", F.length(bare) - F.length(F.translate(bare, '"', ""))), folder)
    split = ["file", "block"]
    inside = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    over_splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    before = lines.groupBy(*split).agg(F.sum("quotes").alias("q")).select(*split, F.coalesce(F.sum("q").over(over_splits), F.lit(0)).alias("before"))
    open_quotes = F.col("before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))
    lines = lines.join(before, split).withColumn("starts", (open_quotes % 2 == 0).cast("long"))
    earlier = lines.groupBy(*split).agg(F.sum("starts").alias("s")).select(*split, F.coalesce(F.sum("s").over(over_splits), F.lit(0)).alias("earlier"))
    upto = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.join(earlier, split).withColumn("record", F.col("earlier") + F.sum("starts").over(upto))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n")
    records = numbered.groupBy("file", "record").agg(F.regexp_replace(whole, r"\r\z", "").alias("value"))
    read = F.from_csv("value", f"{schema}, {CORRUPT} STRING", {"quote": '"', "escape": "\\", "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return records.where("record > 1 AND value <> ''").select(read.alias("r")).select("r.*")  # the first record is the header


def subset_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that were filtered before: standard CSV, quotes are doubled."""
    return spark.read.schema(f"{schema}, {CORRUPT} STRING").options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).csv(path)


def valid(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected(df: DataFrame) -> DataFrame:
    """How many rows do not read. All columns are read, as a file scan of the corrupt column alone is refused."""
    never = F.xxhash64(*[c for c in df.columns if c != CORRUPT]).cast("string") == ""
    return df.agg(F.count(F.when(F.col(CORRUPT).isNotNull() | never, 1)).alias("rejected"), F.count(F.lit(1)).alias("rows"))


def copy_csv(df: DataFrame, path: str) -> None:
    """Rewrite a table as standard CSV."""
    valid(df).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def tsv_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("case STRING, category STRING, iso_date STRING, url STRING").options(sep="\t", header=False).csv(path)


def json_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("state STRING, slug STRING, photo STRING, bio_summary STRING, appointment_date STRING, bio_url STRING, role STRING").option("multiLine", True).json(path)


def text_documents(spark: SparkSession, path: str, page_break: str = "\n\f\n") -> DataFrame:
    """Files of extracted text, a row each; form feeds part the pages, empty pages go."""
    raw = spark.read.format("binaryFile").load(path)
    pages = F.filter(F.transform(F.split(F.col("content").cast("string"), "\f"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.size(pages).alias("pages"), F.array_join(pages, page_break).alias("text"))


def write_partitioned(df: DataFrame, path: str, *columns: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def schema_peek(df: DataFrame) -> DataFrame:
    """Column, type, empty and different values of a table, in one pass."""
    stats = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.count(F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), 1)).alias("empty"), F.approx_count_distinct(n).alias("different")) for n, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
