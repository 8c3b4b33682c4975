"""Registered queries of pages, sitemaps, ends of logs and parse logs. Imported by ``registry``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators import logs as L
from lexlake.operators import parse_logs as G
from lexlake.operators.paging import PagedList
from lexlake.operators.stored import fresh_dir
from lexlake.plans.adapters import ROLES, role
from lexlake.plans.registry import outcome_sql, pct_sql, query, tables
from lexlake.sources import sitemaps as X
from lexlake.sources.tails import tail

HOST = "https://x.example"
FIXED_SQL = "SELECT unnest([" + ", ".join(f"{p!r}" for p in (*X.STATIC, *X.STATIC_STATE)) + "]) AS path, unnest(range(" + str(len(X.STATIC) + len(X.STATIC_STATE)) + ")) AS k"


@query(f"""WITH u AS (SELECT 'opinions' AS kind, row_number() OVER (ORDER BY court_id, case_number, id) - 1 AS pos, '/opinion/' || replace(case_number, ' ', '%20') || '/' AS path, NULL AS lastmod FROM opinion
    UNION ALL SELECT 'judges', row_number() OVER (ORDER BY slug, loc) - 1, loc, day FROM (SELECT slug, '/judge/' || slug || '/' AS loc, CAST(appointment_date AS VARCHAR) AS day FROM (SELECT *, trim(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM judge))
    UNION ALL SELECT 'tags', row_number() OVER (ORDER BY o, slug) - 1, path, NULL FROM (SELECT 0 AS o, '' AS slug, '/tag/' AS path UNION ALL SELECT DISTINCT 1, lower(p_brand), '/tag/' || lower(p_brand) || '/' FROM part)
    UNION ALL SELECT 'statutes', row_number() OVER (ORDER BY slug) - 1, '/statute/' || slug || '/', NULL FROM (SELECT DISTINCT 's-' || CAST(l_partkey % 1500 AS VARCHAR) AS slug FROM lineitem)
    UNION ALL SELECT 'static', k, path, NULL FROM ({FIXED_SQL}))
    SELECT 'sitemap-' || kind || CASE WHEN kind = 'opinions' OR pos >= 400 THEN '-' || CAST(pos // 400 + 1 AS VARCHAR) ELSE '' END || '.xml' AS file, '{HOST}' || path AS loc, lastmod FROM u""", "opinion", "judge")  # fmt: skip
def sitemap_files(spark, d):
    """All addresses, written as XML through the sink and read back."""
    op, judges, part, li = tables(spark, d, "opinion", "judge", "part", "lineitem")
    people = judges.select(S.slugify(F.col("full_name")).alias("slug"), F.col("appointment_date").alias("created"))
    urls = X.sitemap_urls(op, people, part.select(F.lower("p_brand").alias("slug")), li.select(F.concat(F.lit("s-"), F.col("l_partkey") % 1500).alias("slug")), HOST, size=400)
    folder = fresh_dir(spark, "sitemaps")
    X.write_sitemaps(urls, folder, HOST)
    return X.read_sitemaps(spark, folder)


PAGES = (1, 2, 9, 30)


@query(f"""WITH r AS (SELECT id, title, release_date, row_number() OVER (ORDER BY release_date DESC, id) AS pos, count(*) OVER () AS total FROM opinion), p AS (SELECT *, CAST((pos - 1) // 50 + 1 AS INTEGER) AS page FROM r)
    SELECT page, pos, id, title, release_date, total FROM p WHERE page IN {PAGES} OR page = (total + 49) // 50""", "opinion")  # fmt: skip
def page_at_depth(spark, d):
    """Pages of all opinions, newest first, at several depths and at the end."""
    op = role(spark, d, "opinion").select("id", "title", "release_date")
    stored = PagedList.write(op, fresh_dir(spark, "paged-opinions"), F.desc("release_date"), F.col("id"))
    last = -(-stored.total // 50)
    return reduce(DataFrame.unionByName, [stored.page(k, 50).withColumn("page", F.lit(k)) for k in sorted({k for k in PAGES if k <= last} | {last})])


@query("WITH r AS (SELECT id, release_date, row_number() OVER (ORDER BY release_date DESC, id) AS pos FROM opinion) SELECT (pos - 1) // 50 + 1 AS page, id, release_date FROM r WHERE (pos - 1) % 50 = 0", "opinion")
def page_first_rows(spark, d):
    op = role(spark, d, "opinion").select("id", "release_date")
    return PagedList.write(op, fresh_dir(spark, "paged-opinions"), F.desc("release_date"), F.col("id")).first_rows(50).select("page", "id", "release_date")


LAST = 4_000
SHAPE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{s}'" for p, s in L.PAGE_SHAPES) + " ELSE path END"


@query(f"""WITH t AS (SELECT * FROM log ORDER BY event_id DESC LIMIT {LAST}), n AS (SELECT count(*) AS requests, count(*) FILTER (status BETWEEN 500 AND 599) AS errors FROM t)
    SELECT {SHAPE_SQL} AS shape, count(*) AS n, any_value(requests) AS requests, any_value(errors) AS errors, round(100.0::DOUBLE * any_value(errors) / any_value(requests), 3) AS rate, any_value(errors) >= 20 OR any_value(100.0 * errors / requests) >= 1 AS alert FROM t, n WHERE status BETWEEN 500 AND 599 GROUP BY ALL""", "log")  # fmt: skip
def error_rate_tail(spark, d):
    """The log as text in several files, and the errors of its last lines."""
    line = F.format_string('%s - - [01/Mar/2024:10:00:00 +0000] "GET %s HTTP/1.1" %d 145 "-" "%s"', F.col("user_id").cast("string"), "path", "status", "agent")
    folder = fresh_dir(spark, "access-logs")
    role(spark, d, "log").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(folder)
    names = sorted({p for p in spark.read.text(folder).inputFiles()})
    log = tail(spark, names, LAST).select(F.regexp_extract("value", r'"GET (\S+) ', 1).alias("path"), F.regexp_extract("value", r'HTTP/1.1" (\d{3}) ', 1).cast("int").alias("status"))
    return L.error_rate(log)


# Payloads of events as parsers would write them: fields that are there, null, empty or absent, and some that do not read.
ROLES["payload"] = (("events",), """
    SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'MN' WHEN 1 THEN 'NH' ELSE 'AZ' END AS state, event_type, event_id % 4 AS f,
           CASE WHEN event_id % 97 = 0 THEN chr(123) || 'broken' ELSE chr(123) || '"case_number":"A' || CAST(event_id % 900 AS STRING) || '","payload":' || props || ',"case_name":' || CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE '"State v. X"' END
               || CASE WHEN event_id % 5 = 0 THEN '' ELSE ',"disposition":"' || CASE event_id % 2 WHEN 0 THEN 'Affirmed' ELSE 'Reversed' END || '"' END || ',"is_precedential":' || CASE event_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' ELSE 'null' END
               || ',"author":[]' || chr(125) END AS json
    FROM events""")
MISS_SQL = {"case_number": "b", "case_name": "b OR f < 2", "release_date": "true", "is_precedential": "b OR event_id % 3 = 2", "disposition": "b OR event_id % 5 = 0", "author": "true"}


def payload_logs(spark, d):
    rows = role(spark, d, "payload")
    return rows, G.log_rows(rows.select(F.col("event_id").alias("opinion_id"), "json", "state", F.sha2("json", 256).alias("sha")), "sha", "state", "v2")


@query("WITH p AS (SELECT *, event_id % 97 = 0 AS b FROM payload), m AS (" + " UNION ALL ".join(f"SELECT state, '{f}' AS field, {t} AS gone FROM p" for f, t in MISS_SQL.items()) + f""")
    SELECT state AS parser_state, 'v2' AS parser_version, field, count(*) AS texts, count(*) FILTER (NOT gone) AS found, {pct_sql('count(*) FILTER (NOT gone)', 'count(*)')} AS percent FROM m GROUP BY state, field""", "payload")  # fmt: skip
def parse_log_completeness(spark, d):
    return G.completeness(payload_logs(spark, d)[1])


@query(f"""WITH p AS (SELECT *, event_id % 97 = 0 AS b, CASE WHEN event_id % 2 = 0 THEN 'Affirmed' ELSE 'Reversed' END AS new FROM payload)
    SELECT event_id AS id, CASE WHEN b THEN '' ELSE 'A' || CAST(event_id % 900 AS VARCHAR) END AS case_number, CASE WHEN event_id % 6 = 0 THEN 'own' WHEN b OR f < 2 THEN '' ELSE 'State v. X' END AS title,
        CASE WHEN event_id % 7 = 0 THEN 'Remanded' WHEN b OR event_id % 5 = 0 THEN '' ELSE new END AS disposition, CASE WHEN event_id % 7 = 0 THEN 'kept' WHEN b OR event_id % 5 = 0 THEN '' ELSE {outcome_sql('new')} END AS disposition_bucket,
        event_id % 8 <> 1 AND (b OR event_id % 3 <> 0) AS is_precedential FROM p""", "payload")  # fmt: skip
def opinions_filled_from_logs(spark, d):
    """Empty fields are filled, own ones stay; a text that says that it is not precedential counts."""
    rows, logs = payload_logs(spark, d)
    id_ = F.col("event_id")
    own = rows.select(id_.alias("id"), F.lit("").alias("case_number"), F.when(id_ % 6 == 0, "own").otherwise("").alias("title"), F.when(id_ % 7 == 0, "Remanded").otherwise("").alias("disposition"), F.when(id_ % 7 == 0, "kept").otherwise("").alias("disposition_bucket"), (id_ % 8 != 1).alias("is_precedential"))
    return G.filled_opinions(own, logs)


@query("""WITH r AS (SELECT *, CASE WHEN id <= (SELECT CAST(floor(max(id) / 2.0) AS BIGINT) FROM opinion) THEN 'crawl-1' ELSE 'crawl-2' END AS crawl FROM opinion)
    SELECT id, case_number AS docket_number, title AS case_name, CAST(release_date AS VARCHAR) AS date_filed, id * 10 + 1 AS lead_opinion, crawl, CAST(1 AS BIGINT) AS times FROM r""", "opinion")  # fmt: skip
def page_feed_new_items(spark, d):
    """All opinions as pages of an API, newest first, in two crawls of which the second holds all; a stream that stops after the first and goes on reads each once."""
    from lexlake.sources.page_feed import PageFeed, save_pages

    op = role(spark, d, "opinion").select("id", "case_number", "title", "release_date")
    half = op.agg(F.floor(F.max("id") / 2)).first()[0] or 0
    address = F.concat(F.lit(f"{HOST}/api/opinions/"), F.col("id") * 10 + 1, F.lit("/"))
    item = F.struct("id", F.col("case_number").alias("docketNumber"), F.col("title").alias("caseName"), F.col("release_date").cast("string").alias("dateFiled"), F.array(address).alias("sub_opinions"))
    folder, out, mark = (fresh_dir(spark, f"page-feed-{x}") for x in ("in", "out", "mark"))
    spark.dataSource.register(PageFeed)
    for crawl, rows in (("crawl-1", op.where(F.col("id") <= half)), ("crawl-2", op)):
        save_pages(rows, item, folder, crawl)
        spark.readStream.format("page_feed").load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(out)
    return read.groupBy("id", "docket_number", "case_name", "date_filed", F.element_at("opinion_ids", 1).alias("lead_opinion"), "crawl").agg(F.count(F.lit(1)).alias("times"))
