"""Lookups by many keys at once: each takes a table of requests and answers them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators.grams import containing
from lexlake.operators.resolve import docket_lookup, lookup_variants

# Characters of a text and of a quotation that are given out, and rows of a list.
MOST_TEXT, MOST_QUOTE, MOST_NAMES, MOST_OPINIONS = 150_000, 500, 6, 50_000


def opinions_by_docket(requests: DataFrame, opinions: DataFrame, courts: DataFrame, text: str | None = None, most: int = MOST_TEXT) -> DataFrame:
    """request_id, docket, opinion_id, release_date, siblings: the opinion of each requested docket (request_id, docket, want_level, want_date) and how
    many others have the docket in one of its spellings. With ``text``: the beginning of its text, and whether that is not all."""
    best = docket_lookup(requests, opinions, courts)
    variants = requests.select("docket").distinct().withColumn("case_number", F.explode(lookup_variants(F.col("docket"))))
    same = variants.join(opinions.select("case_number", "id"), "case_number").groupBy("docket").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    out = best.join(same, "docket").select("request_id", "docket", "opinion_id", "release_date", "siblings")
    if text is None:
        return out
    own = opinions.select(F.col("id").alias("opinion_id"), F.substring(text, 1, most).alias("full_text"), (F.length(text) > most).alias("truncated"))
    return out.join(own, "opinion_id")


def cites_to_opinions(requests: DataFrame, opinions: DataFrame, parallel: DataFrame, courts: DataFrame) -> DataFrame:
    """cite, matched_by, opinion_ids: what each requested cite stands for, without regard to case: the oldest row (smallest id) with it as
    reporter cite, else as parallel cite (opinion_id, cite), else the opinion of that docket in each state."""
    asked = requests.select(F.trim(S.collapse(F.col("cite"))).alias("cite")).where("cite <> ''").distinct().withColumn("key", F.lower("cite"))
    reporter = opinions.where("reporter_cite <> ''").groupBy(F.lower("reporter_cite").alias("key")).agg(F.min("id").alias("by_reporter"))
    other = parallel.groupBy(F.lower("cite").alias("key")).agg(F.min("opinion_id").alias("by_parallel"))
    rows = asked.join(reporter, "key", "left").join(other, "key", "left")
    left = rows.where("by_reporter IS NULL AND by_parallel IS NULL").select(F.col("cite").alias("docket"), F.lit("").alias("want_level"), F.lit(None).cast("date").alias("want_date"))
    states = courts.select(F.col("id").alias("court_id"), "level", "state_code")
    hits = left.withColumn("case_number", F.explode(lookup_variants(F.col("docket")))).join(opinions.select("case_number", "id", "court_id", "release_date"), "case_number").join(states, "court_id")
    rank = F.when(F.col("level") == "SUPREME", 0).when(F.col("level") == "APPEALS", 1).otherwise(9)
    best = hits.groupBy("docket", "state_code").agg(F.min_by("id", F.struct(rank, -F.unix_date("release_date"), "id")).alias("id"))
    dockets = best.groupBy(F.col("docket").alias("cite")).agg(F.sort_array(F.collect_list("id")).alias("by_docket"))  # one id for each state
    found = rows.join(dockets, "cite", "left").withColumn("one", F.coalesce("by_reporter", "by_parallel"))
    how = F.when(F.col("by_reporter").isNotNull(), "reporter_cite").when(F.col("by_parallel").isNotNull(), "parallel_cite").when(F.col("by_docket").isNotNull(), "docket")
    return found.select("cite", how.alias("matched_by"), F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.col("by_docket")).alias("opinion_ids"))


def judges_by_name(requests: DataFrame, judges: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """name, state_code, judge_id, candidates: the judge of a state with that slug, else the only one whose name contains it; where several
    do, the first ``most`` by id and no judge. Names meet by their rarest gram inside a state."""
    asked = requests.select("name", "state_code").distinct()
    own = judges.select("state_code", F.col("id").alias("its_id"), "slug", F.lower("full_name").alias("lower_name"))
    exact = asked.join(own, (own.state_code == asked.state_code) & (own.slug == asked.name)).groupBy(asked.name, asked.state_code).agg(F.min("its_id").alias("by_slug"))
    inside = containing(asked.select("state_code", F.col("name").alias("q")), judges.select("state_code", F.col("full_name").alias("t")), ("state_code",))
    named = asked.withColumn("q", F.lower("name")).join(inside, ["state_code", "q"])
    some = named.join(own.select("state_code", "its_id", F.col("lower_name").alias("t")), ["state_code", "t"]).select("name", "state_code", "its_id")
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy("name", "state_code").orderBy("its_id"))).where(F.col("rn") <= most)
    near = ranked.groupBy("name", "state_code").agg(F.sort_array(F.collect_list("its_id")).alias("like"))
    rows = asked.join(exact, ["name", "state_code"], "left").join(near, ["name", "state_code"], "left")
    like = F.coalesce("like", F.array().cast("array<bigint>"))
    return rows.select(
        "name", "state_code", F.coalesce("by_slug", F.when(F.size(like) == 1, F.get(like, F.lit(0)))).alias("judge_id"),
        F.when(F.col("by_slug").isNull() & (F.size(like) > 1), like).otherwise(F.array().cast("array<bigint>")).alias("candidates"),
    )


def citing_list(edges: DataFrame, opinions: DataFrame, limit: int = 15, most: int = MOST_QUOTE) -> DataFrame:
    """For each cited opinion its newest ``limit`` citing passages (edges: citing_id, cited_id, treatment, context), with at most ``most`` characters of each."""
    rows = edges.where("cited_id IS NOT NULL").join(opinions.select(F.col("id").alias("citing_id"), "release_date"), "citing_id")
    order = Window.partitionBy("cited_id").orderBy(F.desc_nulls_last("release_date"), "citing_id", "treatment", "context")
    ranked = rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return ranked.select("cited_id", "pos", "citing_id", "release_date", "treatment", F.substring("context", 1, most).alias("quote"))


def opinions_of(mentions: DataFrame, key: str, opinions: DataFrame, limit: int, most: int = MOST_OPINIONS) -> DataFrame:
    """For each value of ``key`` (a statute, a tag) in mentions (key, opinion_id): its number of opinions, up to ``most``, and the newest ``limit`` of them."""
    each = mentions.select(key, "opinion_id").distinct().join(opinions.select(F.col("id").alias("opinion_id"), "release_date"), "opinion_id")
    counts = each.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("opinions"))
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("release_date"), "opinion_id")
    newest = each.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return newest.join(counts, key).select(key, "opinions", "pos", "opinion_id", "release_date")


def in_rank_order(ids: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the given ids (key, pos) in the order of ``pos``; ids without a row are left out."""
    return ids.select(key, "pos").join(rows, key).orderBy("pos", key)


def complement(page: DataFrame, semantic: DataFrame, k: int = 10, key: str = "id") -> DataFrame:
    """The first ``k`` semantic hits (key, distance) without those on the page of word hits already."""
    top = semantic.orderBy("distance", key).limit(k)
    return top.join(page.select(key).distinct(), key, "left_anti").orderBy("distance", key)


def page_with_total(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page and, in each row, the number of rows in all."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row
