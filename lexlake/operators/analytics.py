"""Reports over votes, opinions and courts. ``ref_date`` is always given; nothing depends on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlake.functions import scalars as S


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def agreement(a: Column, b: Column) -> Column:
    """agree, partial, disagree or recused for the buckets of two votes."""
    pair = F.array_sort(F.array(a, b))
    return (
        F.when((a == "recused") | (b == "recused"), "recused").when(a == b, "agree")
        .when(pair == F.array(F.lit("concurrence"), F.lit("majority")), "partial").otherwise("disagree")
    )


def _pairs(votes: DataFrame) -> DataFrame:
    """Votes of two judges on one opinion, each pair once: the join is on the opinion, whose panel is small."""
    v = votes.select("opinion_id", "judge_id", S.vote_bucket(F.col("vote_type")).alias("bucket"))
    a, b = v.select("opinion_id", F.col("judge_id").alias("judge_a"), F.col("bucket").alias("bucket_a")), v.select("opinion_id", F.col("judge_id").alias("judge_b"), F.col("bucket").alias("bucket_b"))
    return a.join(b, "opinion_id").where("judge_a < judge_b").withColumn("how", agreement(F.col("bucket_a"), F.col("bucket_b")))


def _concordance(counts: DataFrame) -> DataFrame:
    """Counts become totals and percentages. The denominator leaves recusals out."""
    c = counts.withColumn("denom", F.col("agree") + F.col("partial") + F.col("disagree"))
    return c.select(
        "judge_a", "judge_b", (F.col("denom") + F.col("recused")).alias("total_shared"), F.col("denom").alias("agreement_denom"), "agree", "partial", "disagree", "recused",
        *[S.percent(F.col(k), F.col("denom")).alias(f"{k}_pct") for k in ("agree", "partial", "disagree")],
    )


def concordance_matrix(votes: DataFrame) -> DataFrame:
    """Every pair of judges that sat together."""
    kinds = ("agree", "partial", "disagree", "recused")
    return _concordance(_pairs(votes).groupBy("judge_a", "judge_b").agg(*[count_if(F.col("how") == k).alias(k) for k in kinds]))


def concordance(votes: DataFrame, judge_a: int, judge_b: int) -> DataFrame:
    """One pair; no row if they never sat together. The filter reaches the scan of either side."""
    low, high = sorted((judge_a, judge_b))
    return concordance_matrix(votes.where(F.col("judge_id").isin(low, high)))


def disagreements(votes: DataFrame, opinions: DataFrame, judge_a: int, judge_b: int, limit: int = 20) -> DataFrame:
    """The latest opinions on which two judges split."""
    split = _pairs(votes.where(F.col("judge_id").isin(judge_a, judge_b))).where("how = 'disagree'")
    return split.join(opinions, split.opinion_id == opinions.id).select("opinion_id", "release_date", "bucket_a", "bucket_b").orderBy(F.desc("release_date"), "opinion_id").limit(limit)


def judge_roles(votes: DataFrame) -> DataFrame:
    """Votes by judge and type, all eight types."""
    return votes.groupBy("judge_id", "vote_type").agg(F.count(F.lit(1)).alias("n"))


def judge_years(votes: DataFrame, opinions: DataFrame) -> DataFrame:
    """Votes by judge and year; years without votes are absent."""
    dates = opinions.select(F.col("id").alias("opinion_id"), F.year("release_date").alias("year"))
    return votes.join(dates, "opinion_id").groupBy("judge_id", "year").agg(F.count(F.lit(1)).alias("n"))


def judge_breakdown(votes: DataFrame, opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """Opinions of each judge by court and outcome, with totals by rollup (null court or bucket)."""
    op = opinions.select(F.col("id").alias("opinion_id"), "court_id", S.disposition_bucket(F.col("disposition")).alias("bucket"))
    rows = votes.select("judge_id", "opinion_id").join(op, "opinion_id").join(courts.select(F.col("id").alias("court_id"), F.col("name").alias("court_name")), "court_id")
    return rows.rollup("judge_id", "court_name", "bucket").agg(F.count(F.lit(1)).alias("n")).where("judge_id IS NOT NULL")


def judge_recent(votes: DataFrame, opinions: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("judge_id").orderBy(F.desc("release_date"), "opinion_id")
    rows = votes.join(opinions.select(F.col("id").alias("opinion_id"), "release_date"), "opinion_id")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select("judge_id", "opinion_id", "release_date", "vote_type", "pos")


def cohort_heat(votes: DataFrame, judges: DataFrame, judge_id: int, limit: int = 12) -> DataFrame:
    """Colleagues ranked by all shared opinions, then name; what is shown leaves recusals out, and both counts are returned."""
    mine = votes.where(F.col("judge_id") == judge_id).select("opinion_id", S.vote_bucket(F.col("vote_type")).alias("mine"))
    rows = votes.where(F.col("judge_id") != judge_id).join(mine, "opinion_id").withColumn("how", agreement(F.col("mine"), S.vote_bucket(F.col("vote_type"))))
    heat = rows.groupBy("judge_id").agg(
        F.count_distinct("opinion_id").alias("shared_all"), count_if(F.col("how") != "recused").alias("shared"),
        count_if(F.col("how") == "agree").alias("aligned"), count_if(F.col("how") == "partial").alias("partial"), count_if(F.col("how") == "disagree").alias("split"),
    )
    return heat.join(judges.select(F.col("id").alias("judge_id"), "full_name"), "judge_id").orderBy(F.desc("shared_all"), "full_name", "judge_id").limit(limit)


def judge_spans(votes: DataFrame, opinions: DataFrame, judges: DataFrame) -> DataFrame:
    """First and last year of each judge and the label of the tenure."""
    dates = opinions.select(F.col("id").alias("opinion_id"), F.year("release_date").alias("year"))
    span = votes.join(dates, "opinion_id").groupBy("judge_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    rows = judges.join(span, judges.id == span.judge_id, "left")
    return rows.select("id", "court_id", "full_name", "first_year", "last_year", S.tenure(F.col("is_currently_seated"), F.col("appointment_date"), F.col("first_year"), F.col("last_year")).alias("tenure"))


def roster_by_decade(spans: DataFrame) -> DataFrame:
    """Judges by court and by each decade that their span overlaps."""
    base = spans.where("first_year IS NOT NULL")
    decades = F.sequence(F.floor(F.col("first_year") / 10).cast("int"), F.floor(F.col("last_year") / 10).cast("int"))
    return base.withColumn("decade", F.explode(F.transform(decades, lambda d: d * 10))).groupBy("decade", "court_id").agg(F.count(F.lit(1)).alias("judges"))


def busiest_judges(votes: DataFrame, judges: DataFrame, limit: int = 8) -> DataFrame:
    top = votes.groupBy("judge_id").agg(F.count(F.lit(1)).alias("votes"))
    return top.join(judges.select(F.col("id").alias("judge_id"), "full_name"), "judge_id").orderBy(F.desc("votes"), "judge_id").limit(limit)


def judge_picker(votes: DataFrame, judges: DataFrame, limit: int = 250) -> DataFrame:
    n = votes.groupBy("judge_id").agg(F.count(F.lit(1)).alias("votes"))
    return judges.join(n, judges.id == n.judge_id).where("votes > 0").orderBy("full_name", "id").limit(limit).select("id", "full_name", "votes")


def disposition_mix(opinions: DataFrame) -> DataFrame:
    """Share of each outcome; opinions without one count as "none". The total is an aggregate of the counts, not of the rows."""
    by = opinions.groupBy(S.disposition_bucket(F.col("disposition")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(F.when(F.col("bucket") == "", "none").otherwise(F.col("bucket")).alias("bucket"), "n", S.percent(F.col("n"), F.col("total")).alias("pct"))


def caseload_trend(opinions: DataFrame, ref_date: str, years: int = 10) -> DataFrame:
    start = F.make_date(F.year(F.lit(ref_date).cast("date")) - years, F.lit(1), F.lit(1))
    by = opinions.where(F.col("release_date") >= start).groupBy(F.year("release_date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    top = by.agg(F.max("n").alias("top"))
    return by.crossJoin(F.broadcast(top)).select("year", "n", S.bar(F.col("n"), F.col("top")).alias("bar"))


def year_picker(opinions: DataFrame, courts: DataFrame) -> DataFrame:
    """Opinions by state and year, with totals by state and in all."""
    rows = opinions.join(courts.select(F.col("id").alias("court_id"), "state_code"), "court_id").select("state_code", F.year("release_date").alias("year"))
    return rows.rollup("state_code", "year").agg(F.count(F.lit(1)).alias("n"))


def landing_stats(opinions: DataFrame, courts: DataFrame, judges: DataFrame) -> DataFrame:
    states = courts.select(F.col("id").alias("court_id"), "state_code")
    op = opinions.join(states, "court_id").groupBy("state_code").agg(F.count(F.lit(1)).alias("opinions"), F.min("release_date").alias("first_date"), F.max("release_date").alias("last_date"))
    jd = judges.join(states, "court_id").groupBy("state_code").agg(count_if(F.col("is_currently_seated")).alias("seated"))
    return op.join(jd, "state_code", "left").withColumn("seated", F.coalesce("seated", F.lit(0)))


def landing_latest(opinions: DataFrame, courts: DataFrame, ref_date: str, window_days: int = 180, n: int = 5, stale_days: int = 30) -> DataFrame:
    """The latest opinions of each state, within a window that ends at its newest one, and whether the state is stale."""
    rows = opinions.join(courts.select(F.col("id").alias("court_id"), "state_code"), "court_id").select("state_code", "id", "release_date")
    by = Window.partitionBy("state_code")
    newest = rows.groupBy("state_code").agg(F.max("release_date").alias("newest"))
    near = rows.join(newest, "state_code").where(F.col("release_date") >= F.date_sub("newest", window_days))
    ranked = near.withColumn("pos", F.row_number().over(by.orderBy(F.desc("release_date"), "id"))).where(F.col("pos") <= n)
    return ranked.select("state_code", "id", "release_date", "pos", (F.datediff(F.lit(ref_date).cast("date"), "newest") > stale_days).alias("stale"))


# Days after which a state is stale.
STALE_DAYS = {"MN": 45, "AZ": 45, "NH": 60}
STALE_OTHER = 45


def freshness(opinions: DataFrame, courts: DataFrame, ref_date: str) -> DataFrame:
    """Age of the newest opinion of each state; a state without one is stale."""
    states = courts.select(F.col("id").alias("court_id"), "state_code")
    last = states.join(opinions.select("court_id", "release_date"), "court_id", "left").groupBy("state_code").agg(F.max("release_date").alias("newest"))
    limit = F.coalesce(*[F.when(F.col("state_code") == k, v) for k, v in STALE_DAYS.items()], F.lit(STALE_OTHER))
    age = F.datediff(F.lit(ref_date).cast("date"), "newest")
    return last.select("state_code", "newest", age.alias("age_days"), limit.alias("limit_days"), F.coalesce(age > limit, F.lit(True)).alias("stale"))


def coverage_anomalies(opinions: DataFrame, courts: DataFrame, base: tuple[int, int], recent: tuple[int, ...], least_years: int = 5, least_base: float = 100, ratio: float = 0.6, top: int = 40) -> DataFrame:
    """Courts whose recent years fall short of the median of the base years, and where unpublished opinions died out."""
    rows = opinions.select("court_id", F.year("release_date").alias("year"), F.col("is_precedential").alias("pub"))
    by = rows.groupBy("court_id", "year").agg(F.count(F.lit(1)).alias("total"), count_if(~F.col("pub")).alias("unpublished"))
    baseline = by.where(F.col("year").between(*base)).groupBy("court_id").agg(
        F.count(F.lit(1)).alias("years"), F.median("total").alias("baseline"), F.median(F.col("unpublished") / F.greatest("total", F.lit(1))).alias("base_share")
    ).where((F.col("years") >= least_years) & (F.col("baseline") >= least_base))
    wanted = baseline.withColumn("year", F.explode(F.array(*map(F.lit, recent))))
    found = wanted.join(by, ["court_id", "year"], "left").withColumns({"total": F.coalesce("total", F.lit(0)), "unpublished": F.coalesce("unpublished", F.lit(0))})
    found = found.withColumns({"ratio": F.col("total") / F.col("baseline"), "share": F.col("unpublished") / F.greatest("total", F.lit(1))}).where(F.col("ratio") < ratio)
    named = found.join(courts.select(F.col("id").alias("court_id"), "name"), "court_id")
    severity = F.col("baseline") * (1 - F.col("ratio"))
    return named.select(
        "court_id", "name", "year", "baseline", "total", F.round("ratio", 6).alias("ratio"), F.round(severity, 6).alias("severity"), ((F.col("base_share") >= 0.30) & (F.col("share") < 0.10)).alias("unpublished_died")
    ).orderBy(F.desc("severity"), F.desc("court_id"), F.desc("year")).limit(top)


def review_progress(labels: DataFrame) -> DataFrame:
    """Counts by status and the share of all that is resolved."""
    by = labels.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("status") != "pending", F.col("n")).otherwise(0)).alias("resolved"))
    return by.crossJoin(F.broadcast(total)).select("status", "n", S.percent(F.col("n"), F.col("total")).alias("pct"), S.percent(F.col("resolved"), F.col("total")).alias("resolved_pct"))


def tag_index(tags: DataFrame, opinions: DataFrame) -> DataFrame:
    """How many of the given opinions each tag has, and the date of the newest; tags without any are left out. The opinions of a tag: ``lookups.opinions_of``."""
    rows = tags.join(opinions.select(F.col("id").alias("opinion_id"), "release_date"), "opinion_id")
    return rows.groupBy("category", "tag").agg(F.count_distinct("opinion_id").alias("n"), F.max("release_date").alias("newest")).where("n > 0")


def yearly_chart(years: DataFrame, key: str, width: float = 720, height: float = 240, left: float = 48, right: float = 16, top: float = 16, bottom: float = 32) -> DataFrame:
    """Axis and polyline of each key's yearly series (key, year, n)."""
    by = years.groupBy(key).agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.max("n").alias("n_max"), F.sort_array(F.collect_list(F.struct("year", "n"))).alias("rows"))
    by = by.withColumns({"value_max": S.nice_max(F.col("n_max")), "span": F.col("year_max") - F.col("year_min")})
    w, h = width - left - right, height - top - bottom
    x = lambda y: F.when(F.col("span") == 0, left + w / 2).otherwise(left + (y - F.col("year_min")) / F.nullif(F.col("span"), F.lit(0)) * w)
    y = lambda n: top + h - n / F.col("value_max") * h
    points = F.array_join(F.transform("rows", lambda r: F.concat(F.format_string("%.1f", x(r["year"]).cast("double")), F.lit(","), F.format_string("%.1f", y(r["n"]).cast("double")))), " ")
    ticks = F.sequence(F.col("year_min"), F.col("year_max"), S.tick_step(F.col("span")))
    ticks = F.when(F.element_at(ticks, -1) != F.col("year_max"), F.array_append(ticks, F.col("year_max"))).otherwise(ticks)
    y_ticks = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.bround(F.col("value_max") * i / 5, 0).cast("long"))
    return by.select(key, "year_min", "year_max", "value_max", points.alias("points"), ticks.alias("x_ticks"), y_ticks.alias("y_ticks"))
