"""Substring search for many queries at once: a filter on character grams with a count bound, then the comparison itself.

A text that contains a query has all of its grams. Grams are as long as the longest of LADDER that the query has room for, so what many texts share in a few characters (the
digits of a number) is not looked under by longer queries. Each query looks for texts under its rarest gram alone (grams are counted over the different texts), the
count bound asks that all its other grams are there too, and what is left is compared. So a gram that most texts have is looked under only by queries
that have no rarer one, and no two tables meet on anything broader than a gram. Only lengths that some query uses are made of texts. Case does not count; "%" and "_" are plain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
LADDER = (1, 2, SIZE, 4, 8, 16, 32, 64, 128)


def gram_size(q: Column) -> Column:
    return F.greatest(*[F.when(F.length(q) >= n, n).otherwise(1) for n in LADDER])


def grams(text: Column, size: Column | int = SIZE) -> Column:
    """The different runs of ``size`` characters of a text; none where it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, size)))).otherwise(F.array().cast("array<string>"))


def query_grams(q: Column) -> Column:
    return grams(q, gram_size(q))


def candidates(queries: DataFrame, texts: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``within``, q, t: lower-case queries (q) and texts (t), each different one once, where the text has all grams of the query. Both tables hold the columns of ``within``, which must be
    equal (a state, a court)."""
    asked = queries.select(*within, F.lower("q").alias("q")).where("q <> ''").distinct().withColumn("grams", query_grams(F.col("q")))
    own = texts.select(*within, F.lower("t").alias("t")).where("t IS NOT NULL").distinct()
    used = asked.select(*within, F.explode("grams").alias("gram")).distinct()
    sizes = sorted(r.n for r in asked.select(gram_size(F.col("q")).alias("n")).distinct().collect()) or [SIZE]  # at most those of LADDER
    rows = own.select(*within, "t", F.explode(F.concat(*[grams(F.col("t"), n) for n in sizes])).alias("gram")).join(used, [*within, "gram"], "left_semi")
    counts = rows.groupBy(*within, "gram").agg(F.count(F.lit(1)).alias("n"))
    each = asked.select(*within, "q", F.explode("grams").alias("gram")).join(counts, [*within, "gram"], "left")
    rarest = each.groupBy(*within, "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r")).select(*within, "q", "r.gram")
    met = rarest.join(rows, [*within, "gram"])
    return met.where(F.forall(query_grams(F.col("q")), lambda g: F.contains("t", g))).select(*within, "q", "t")


def containing(queries: DataFrame, texts: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``within``, q, t: the lower-case texts that contain each lower-case query."""
    return candidates(queries, texts, within).where(F.contains("t", F.col("q")))
