"""Registered queries of aggregates that are kept up to date by increments. Imported by ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators.stored import fresh_dir, tasks_of
from lexlake.operators.views import View, changes, counted
from lexlake.plans.registry import TAG_SQL, query, tables


@query(f"WITH t AS ({TAG_SQL}) SELECT tag, CAST(count(*) AS BIGINT) AS n, count(DISTINCT opinion_id) AS opinions FROM t WHERE opinion_id % 9 <> 0 OR opinion_id % 18 = 0 GROUP BY tag")
def incremental_tag_counts(spark, d):
    """Four increments of new tags, one that takes a ninth of the opinions back, one that brings half of these again; the run stops after each second increment and goes on."""
    li, part = tables(spark, d, "lineitem", "part")
    tags = li.join(part, li.l_partkey == part.p_partkey).select(F.col("p_brand").alias("tag"), F.col("l_orderkey").alias("opinion_id")).repartition(tasks_of(li), "opinion_id")
    came, went = F.lit(1).alias("change"), F.lit(-1).alias("change")
    steps = [(k, lambda k=k: tags.where(F.col("opinion_id") % 4 == k).select("*", came)) for k in range(4)]
    steps += [(4, lambda: tags.where("opinion_id % 9 = 0").select("*", went)), (5, lambda: tags.where("opinion_id % 18 = 0").select("*", came))]
    view, ticks = View(spark, fresh_dir(spark, "tag-view"), "tag STRING, opinion_id BIGINT", buckets=8), iter(range(1_000))
    while not view.run(steps, seconds=2, clock=lambda: next(ticks)):
        view.vacuum()
    return counted(view.rows(), ("tag",), distinct={"opinions": "opinion_id"})


@query("""WITH o AS (SELECT o.id, state_code, CASE WHEN o.id % 7 = 0 THEN CAST(release_date + INTERVAL 1 YEAR AS DATE) ELSE release_date END AS day FROM opinion o JOIN court c ON c.id = court_id WHERE o.id % 50 <> 0),
    a AS (SELECT state_code, CAST(count(*) AS BIGINT) AS opinions, min(day) AS first_date, max(day) AS last_date FROM o GROUP BY ALL), t AS (SELECT state_code, count(DISTINCT p_type) AS tags FROM o JOIN lineitem ON l_orderkey = o.id JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    j AS (SELECT state_code, CAST(count(*) AS BIGINT) AS judges, CAST(count(*) FILTER (is_currently_seated AND judge.id % 4 <> 1) AS BIGINT) AS seated FROM judge JOIN court c ON c.id = court_id GROUP BY ALL)
    SELECT state_code, opinions, first_date, last_date, tags, judges, seated FROM a JOIN t USING (state_code) JOIN j USING (state_code)""", "opinion", "court", "judge")  # fmt: skip
def incremental_landing_stats(spark, d):
    """The landing page's figures of each state: opinions, their dates, different tags and judges, kept up to date while opinions come, move and go and judges leave."""
    op, courts, judges, li, part = tables(spark, d, "opinion", "court", "judge", "lineitem", "part")
    states = courts.select(F.col("id").alias("court_id"), "state_code")
    none = {"day": F.lit(None).cast("date"), "tag": F.lit(None).cast("string"), "seated": F.lit(None).cast("boolean")}
    row = lambda df, kind, **own: df.select("state_code", F.lit(kind).alias("kind"), *[(own.get(c, v)).alias(c) for c, v in none.items()])
    tagged = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("id"), "p_type")

    def facts(opinions, people):
        own = opinions.join(states, "court_id")
        return row(own, "opinion", day=F.col("release_date")).unionByName(row(own.join(tagged, "id"), "tag", tag=F.col("p_type"))).unionByName(row(people.join(states, "court_id"), "judge", seated=F.col("is_currently_seated")))

    moved = op.withColumn("release_date", F.when(F.col("id") % 7 == 0, F.add_months("release_date", 12)).otherwise(F.col("release_date")))
    left = judges.withColumn("is_currently_seated", F.col("is_currently_seated") & (F.col("id") % 4 != 1))
    tables_ = [(op.where("id % 3 = 0"), judges), (op, judges), (moved, judges), (moved.where("id % 50 <> 0"), left)]
    view = View(spark, fresh_dir(spark, "landing-view"), "state_code STRING, kind STRING, day DATE, tag STRING, seated BOOLEAN", buckets=4)
    before = facts(op.limit(0), judges.limit(0))
    for k, (opinions, people) in enumerate(tables_):
        after = facts(opinions, people)
        view.apply(changes(before, after), k)
        before = after
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    kind = F.col("kind")
    figures = [n(kind == "opinion").alias("opinions"), F.min("day").alias("first_date"), F.max("day").alias("last_date"), F.count_distinct("tag").alias("tags"), n(kind == "judge").alias("judges"), n(F.col("seated")).alias("seated")]
    return view.rows().groupBy("state_code").agg(*figures).where("opinions > 0 AND judges > 0")


@query("""WITH h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, ts, event_id AS id, sha256(CASE WHEN event_type IS NULL THEN '-' ELSE '=' || base64(encode(event_type)) END || ',' || CASE WHEN props IS NULL THEN '-' ELSE '=' || base64(encode(props)) END) AS sha256 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    l AS (SELECT *, lag(sha256) OVER w AS s, lag(ts) OVER w AS t FROM h WINDOW w AS (PARTITION BY key ORDER BY ts, id)) SELECT key, id, sha256, true AS pending FROM l WHERE s IS NULL OR s <> sha256 OR ts - t > INTERVAL 30 DAY""")  # fmt: skip
def pending_changes(spark, d):
    """Events whose content is not that of the user's event before, or that come 30 days after it; all rows come twice, and a row that comes again counts once."""
    from lexlake.streaming.changes import content_changes

    ev = tables(spark, d, "events")[0]
    return content_changes(ev.union(ev), "user_id", "ts", "event_id", ("event_type", "props"), 30 * 86_400).select("key", "id", "sha256", "pending")
