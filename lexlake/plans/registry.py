"""The registered queries: each operator over the role tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlake.functions import legal_text as T
from lexlake.functions import scalars as S
from lexlake.operators import analytics as A
from lexlake.operators import graph as G
from lexlake.operators import ingest as I
from lexlake.operators import logs as L
from lexlake.operators import resolve as R
from lexlake.operators import search as Q
from lexlake.operators.stored import tasks_of
from lexlake.plans.adapters import REF_DATE, oracle, role
from lexlake.schemas import VOTES
from lexlake.sources import rosters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *roles: str) -> Callable:
    """Register a query; ``sql`` reads the roles named after it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(sql, *roles)
        return f

    return add


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [role(spark, sf_dir, n) for n in names]


# --- fragments of the checking SQL ---------------------------------------------------------------------------------------------

def vote_bucket_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{v}' THEN '{b}'" for v, (_, b) in VOTES.items()) + " ELSE 'recused' END"


def outcome_sql(c: str = "disposition") -> str:
    d = f"lower(trim({c}))"
    tests = [f"WHEN {' OR '.join(f'contains({d}, {w!r})' if where == 'in' else f'starts_with({d}, {w!r})' for w in words)} THEN '{bucket}'" for where, words, bucket in S.DISPOSITIONS]
    return f"CASE WHEN {d} = '' THEN '' {' '.join(tests)} ELSE 'other' END"


def pct_sql(n: str, d: str, digits: int = 1) -> str:
    return f"CASE WHEN {d} > 0 THEN round_even(100.0::DOUBLE * {n} / {d}, {digits}) ELSE 0.0::DOUBLE END"


CANON_SQL = """CASE WHEN trim(case_number) = '' OR regexp_matches(trim(case_number), '(?i)^cl-[0-9]+$') THEN trim(case_number)
    WHEN regexp_matches(trim(case_number), '^[aA][0-9]{6}$') THEN upper(substr(trim(case_number), 1, 1)) || substr(trim(case_number), 2, 2) || '-' || substr(trim(case_number), 4)
    WHEN regexp_matches(regexp_replace(trim(case_number), '^N[Oo][Ss]?\\.?\\s+', ''), '^[A-Z][0-9]{2}-[0-9]{1,3}$')
        THEN substr(regexp_replace(trim(case_number), '^N[Oo][Ss]?\\.?\\s+', ''), 1, 4) || lpad(substr(regexp_replace(trim(case_number), '^N[Oo][Ss]?\\.?\\s+', ''), 5), 4, '0')
    ELSE trim(regexp_replace(trim(case_number), '^N[Oo][Ss]?\\.?\\s+', '')) END"""
PAIRS_SQL = f"""b AS (SELECT opinion_id, judge_id, {vote_bucket_sql('vote_type')} AS bucket FROM vote),
    p AS (SELECT x.opinion_id, x.judge_id AS judge_a, y.judge_id AS judge_b, x.bucket AS bucket_a, y.bucket AS bucket_b,
          CASE WHEN x.bucket = 'recused' OR y.bucket = 'recused' THEN 'recused' WHEN x.bucket = y.bucket THEN 'agree'
               WHEN x.bucket IN ('majority', 'concurrence') AND y.bucket IN ('majority', 'concurrence') THEN 'partial' ELSE 'disagree' END AS how
          FROM b x JOIN b y ON x.opinion_id = y.opinion_id AND x.judge_id < y.judge_id)"""


# --- judges ----------------------------------------------------------------------------------------------------------------------

@query(f"""WITH {PAIRS_SQL}, c AS (SELECT judge_a, judge_b, count(*) FILTER (how = 'agree') AS agree, count(*) FILTER (how = 'partial') AS partial, count(*) FILTER (how = 'disagree') AS disagree, count(*) FILTER (how = 'recused') AS recused FROM p GROUP BY ALL)
    SELECT judge_a, judge_b, agree + partial + disagree + recused AS total_shared, agree + partial + disagree AS agreement_denom, agree, partial, disagree, recused,
    {pct_sql('agree', '(agree + partial + disagree)')} AS agree_pct, {pct_sql('partial', '(agree + partial + disagree)')} AS partial_pct, {pct_sql('disagree', '(agree + partial + disagree)')} AS disagree_pct FROM c""", "vote")  # fmt: skip
def concordance_matrix(spark, d):
    return A.concordance_matrix(role(spark, d, "vote", {"lineitem": "l_orderkey"}))


@query(f"""WITH {PAIRS_SQL} SELECT opinion_id, release_date, bucket_a, bucket_b FROM p JOIN opinion o ON o.id = opinion_id WHERE judge_a = 1 AND judge_b = 2 AND how = 'disagree' ORDER BY release_date DESC, opinion_id LIMIT 20""", "vote", "opinion")
def judge_disagreements(spark, d):
    return A.disagreements(*tables(spark, d, "vote", "opinion"), 1, 2)


@query("SELECT judge_id, vote_type, count(*) AS n FROM vote GROUP BY ALL", "vote")
def judge_dossier_roles(spark, d):
    return A.judge_roles(role(spark, d, "vote"))


@query("SELECT judge_id, CAST(year(release_date) AS INTEGER) AS year, count(*) AS n FROM vote JOIN opinion o ON o.id = opinion_id GROUP BY ALL", "vote", "opinion")
def judge_yearly_votes(spark, d):
    return A.judge_years(*tables(spark, d, "vote", "opinion"))


@query(f"SELECT judge_id, court_name, bucket, n FROM (SELECT judge_id, c.name AS court_name, {outcome_sql()} AS bucket, count(*) AS n FROM vote JOIN opinion o ON o.id = opinion_id JOIN court c ON c.id = o.court_id GROUP BY ROLLUP (judge_id, court_name, bucket)) WHERE judge_id IS NOT NULL", "vote", "opinion", "court")
def judge_dossier_breakdown(spark, d):
    return A.judge_breakdown(*tables(spark, d, "vote", "opinion", "court"))


@query("SELECT judge_id, opinion_id, release_date, vote_type, CAST(pos AS INTEGER) AS pos FROM (SELECT judge_id, opinion_id, release_date, vote_type, row_number() OVER (PARTITION BY judge_id ORDER BY release_date DESC, opinion_id) AS pos FROM vote JOIN opinion o ON o.id = opinion_id) WHERE pos <= 15", "vote", "opinion")
def judge_dossier_recent(spark, d):
    return A.judge_recent(*tables(spark, d, "vote", "opinion"))


@query(f"""WITH b AS (SELECT opinion_id, judge_id, {vote_bucket_sql('vote_type')} AS bucket FROM vote),
    h AS (SELECT y.judge_id, y.opinion_id, CASE WHEN x.bucket = 'recused' OR y.bucket = 'recused' THEN 'recused' WHEN x.bucket = y.bucket THEN 'agree' WHEN x.bucket IN ('majority', 'concurrence') AND y.bucket IN ('majority', 'concurrence') THEN 'partial' ELSE 'disagree' END AS how
          FROM b x JOIN b y ON x.opinion_id = y.opinion_id AND x.judge_id = 1 AND y.judge_id <> 1)
    SELECT judge_id, count(DISTINCT opinion_id) AS shared_all, count(*) FILTER (how <> 'recused') AS shared, count(*) FILTER (how = 'agree') AS aligned, count(*) FILTER (how = 'partial') AS partial, count(*) FILTER (how = 'disagree') AS split, any_value(full_name) AS full_name
    FROM h JOIN judge j ON j.id = judge_id GROUP BY judge_id ORDER BY shared_all DESC, full_name, judge_id LIMIT 12""", "vote", "judge")  # fmt: skip
def cohort_heat_topn(spark, d):
    return A.cohort_heat(*tables(spark, d, "vote", "judge"), 1)


SPAN_SQL = "s AS (SELECT judge_id, CAST(min(year(release_date)) AS INTEGER) AS first_year, CAST(max(year(release_date)) AS INTEGER) AS last_year FROM vote JOIN opinion o ON o.id = opinion_id GROUP BY judge_id)"


@query(f"""WITH {SPAN_SQL} SELECT id, court_id, full_name, first_year, last_year, CASE WHEN is_currently_seated AND appointment_date IS NOT NULL THEN 'Seated ' || year(appointment_date) WHEN is_currently_seated AND first_year IS NOT NULL THEN 'On the bench since ' || first_year
    WHEN is_currently_seated THEN 'Currently seated' WHEN first_year = last_year THEN 'Active ' || first_year WHEN first_year IS NOT NULL THEN 'Active ' || first_year || '–' || last_year ELSE 'Former judge' END AS tenure FROM judge LEFT JOIN s ON judge_id = id""", "vote", "opinion", "judge")  # fmt: skip
def judge_roster_spans(spark, d):
    return A.judge_spans(*tables(spark, d, "vote", "opinion", "judge"))


@query(f"WITH {SPAN_SQL}, x AS (SELECT court_id, unnest(range(first_year // 10, last_year // 10 + 1)) * 10 AS decade FROM judge JOIN s ON judge_id = id) SELECT CAST(decade AS INTEGER) AS decade, court_id, count(*) AS judges FROM x GROUP BY ALL", "vote", "opinion", "judge")
def judge_roster_decade(spark, d):
    return A.roster_by_decade(A.judge_spans(*tables(spark, d, "vote", "opinion", "judge")))


@query("SELECT judge_id, count(*) AS votes, any_value(full_name) AS full_name FROM vote JOIN judge j ON j.id = judge_id GROUP BY judge_id ORDER BY votes DESC, judge_id LIMIT 8", "vote", "judge")
def busiest_judges_topk(spark, d):
    return A.busiest_judges(*tables(spark, d, "vote", "judge"))


@query("SELECT j.id, any_value(full_name) AS full_name, count(*) AS votes FROM vote JOIN judge j ON j.id = judge_id GROUP BY j.id ORDER BY full_name, j.id LIMIT 250", "vote", "judge")
def judge_picker(spark, d):
    return A.judge_picker(*tables(spark, d, "vote", "judge"))


NICE_SQL = "CASE WHEN m <= 5 THEN 5 WHEN m <= 10 THEN 10 WHEN m <= 50 THEN (m // 10 + 1) * 10 WHEN m <= 200 THEN (m // 25 + 1) * 25 WHEN m <= 1000 THEN (m // 100 + 1) * 100 ELSE (m // 500 + 1) * 500 END"


@query(f"""WITH y AS (SELECT judge_id, CAST(year(release_date) AS INTEGER) AS year, count(*) AS n FROM vote JOIN opinion o ON o.id = opinion_id GROUP BY ALL), g AS (SELECT judge_id, min(year) AS year_min, max(year) AS year_max, max(n) AS m FROM y GROUP BY judge_id), v AS (SELECT *, {NICE_SQL} AS value_max FROM g)
    SELECT v.judge_id, year_min, year_max, CAST(value_max AS BIGINT) AS value_max, string_agg(printf('%.1f', CASE WHEN year_min = year_max THEN 376.0::DOUBLE ELSE 48.0::DOUBLE + (year - year_min)::DOUBLE / (year_max - year_min) * 656 END) || ',' || printf('%.1f', 208.0::DOUBLE - n::DOUBLE / value_max * 192), ' ' ORDER BY year) AS points
    FROM v JOIN y ON y.judge_id = v.judge_id GROUP BY ALL""", "vote", "opinion")  # fmt: skip
def chart_payload(spark, d):
    return A.yearly_chart(A.judge_years(*tables(spark, d, "vote", "opinion")), "judge_id").select("judge_id", "year_min", "year_max", "value_max", "points")


# --- the corpus -------------------------------------------------------------------------------------------------------------------

@query(f"WITH b AS (SELECT {outcome_sql()} AS bucket, count(*) AS n FROM opinion GROUP BY ALL), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM b) SELECT CASE WHEN bucket = '' THEN 'none' ELSE bucket END AS bucket, n, {pct_sql('n', 'total')} AS pct FROM b, t", "opinion")
def disposition_mix_pct(spark, d):
    return A.disposition_mix(role(spark, d, "opinion"))


@query(f"SELECT id, {outcome_sql()} AS bucket FROM opinion", "opinion")
def disposition_buckets(spark, d):
    return role(spark, d, "opinion").select("id", S.disposition_bucket(F.col("disposition")).alias("bucket"))


@query(f"WITH y AS (SELECT CAST(year(release_date) AS INTEGER) AS year, count(*) AS n FROM opinion WHERE release_date >= make_date(year(DATE '{REF_DATE}') - 10, 1, 1) GROUP BY ALL) SELECT year, n, repeat('#', CAST(floor(40 * n / (SELECT max(n) FROM y)) AS INTEGER)) AS bar FROM y", "opinion")
def caseload_trend(spark, d):
    return A.caseload_trend(role(spark, d, "opinion"), REF_DATE)


@query("SELECT state_code, CAST(year(release_date) AS INTEGER) AS year, count(*) AS n FROM opinion o JOIN court c ON c.id = court_id GROUP BY ROLLUP (state_code, CAST(year(release_date) AS INTEGER))", "opinion", "court")
def state_year_picker(spark, d):
    return A.year_picker(*tables(spark, d, "opinion", "court"))


@query("WITH o AS (SELECT state_code, count(*) AS opinions, min(release_date) AS first_date, max(release_date) AS last_date FROM opinion JOIN court c ON c.id = court_id GROUP BY state_code), j AS (SELECT state_code, count(*) FILTER (is_currently_seated) AS seated FROM judge JOIN court c ON c.id = court_id GROUP BY state_code) SELECT o.state_code, opinions, first_date, last_date, coalesce(seated, 0) AS seated FROM o LEFT JOIN j USING (state_code)", "opinion", "court", "judge")
def state_landing_stats(spark, d):
    return A.landing_stats(*tables(spark, d, "opinion", "court", "judge"))


@query(f"WITH r AS (SELECT state_code, o.id, release_date, max(release_date) OVER (PARTITION BY state_code) AS newest FROM opinion o JOIN court c ON c.id = court_id), k AS (SELECT *, row_number() OVER (PARTITION BY state_code ORDER BY release_date DESC, id) AS pos FROM r WHERE release_date >= newest - 180) SELECT state_code, id, release_date, CAST(pos AS INTEGER) AS pos, (DATE '{REF_DATE}' - newest) > 30 AS stale FROM k WHERE pos <= 5", "opinion", "court")
def landing_latest(spark, d):
    return A.landing_latest(*tables(spark, d, "opinion", "court"), REF_DATE)


@query(f"WITH f AS (SELECT state_code, max(release_date) AS newest FROM court c LEFT JOIN opinion o ON c.id = o.court_id GROUP BY state_code), g AS (SELECT *, CAST(DATE '{REF_DATE}' - newest AS INTEGER) AS age_days, CASE WHEN state_code = 'NH' THEN 60 ELSE 45 END AS limit_days FROM f) SELECT state_code, newest, age_days, limit_days, coalesce(age_days > limit_days, true) AS stale FROM g", "opinion", "court")
def freshness_report(spark, d):
    return A.freshness(*tables(spark, d, "opinion", "court"), REF_DATE)


@query("""WITH b AS (SELECT court_id, year(release_date) AS year, count(*) AS total, count(*) FILTER (NOT is_precedential) AS unpublished FROM opinion GROUP BY ALL),
    l AS (SELECT court_id, median(total) AS baseline, median(unpublished / greatest(total, 1)) AS base_share FROM b WHERE year BETWEEN 1995 AND 1999 GROUP BY court_id HAVING count(*) >= 5 AND median(total) >= 1),
    w AS (SELECT *, unnest([2000, 2001, 2002]) AS year FROM l), f AS (SELECT w.court_id, w.year, baseline, base_share, coalesce(total, 0) AS total, coalesce(unpublished, 0) AS unpublished FROM w LEFT JOIN b ON b.court_id = w.court_id AND b.year = w.year),
    r AS (SELECT *, total / baseline AS ratio, baseline * (1 - total / baseline) AS severity FROM f WHERE total / baseline < 0.9)
    SELECT court_id, name, CAST(year AS INTEGER) AS year, baseline, total, round(ratio, 6) AS ratio, round(severity, 6) AS severity, (base_share >= 0.30 AND unpublished / greatest(total, 1) < 0.10) AS unpublished_died FROM r JOIN court c ON c.id = court_id ORDER BY severity DESC, court_id DESC, year DESC LIMIT 40""", "opinion", "court")  # fmt: skip
def coverage_anomaly_audit(spark, d):
    return A.coverage_anomalies(*tables(spark, d, "opinion", "court"), (1995, 1999), (2000, 2001, 2002), least_base=1, ratio=0.9)


LABEL_SQL = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'pending' END"


@query(f"WITH b AS (SELECT {LABEL_SQL} AS status, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (status <> 'pending') AS BIGINT) AS resolved FROM b) SELECT status, n, {pct_sql('n', 'total')} AS pct, {pct_sql('resolved', 'total')} AS resolved_pct FROM b, t")
def review_queue_progress(spark, d):
    return A.review_progress(role(spark, d, "labels").select(F.expr(LABEL_SQL).alias("status")))


TAG_SQL = "SELECT l_orderkey AS opinion_id, p_type AS category, p_brand AS tag FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(f"WITH t AS ({TAG_SQL}) SELECT category, tag, count(DISTINCT opinion_id) AS n, max(release_date) AS newest FROM t JOIN opinion o ON o.id = opinion_id WHERE o.court_id < 10 GROUP BY ALL", "opinion")
def tag_index_filtered_count(spark, d):
    li, part = tables(spark, d, "lineitem", "part")
    tags = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("opinion_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("tag"))
    return A.tag_index(tags.repartition(tasks_of(li), "opinion_id"), role(spark, d, "opinion").where("court_id < 10"))


@query("SELECT CAST(l_partkey % 500 AS VARCHAR) AS statute, count(*) AS mentions, count(DISTINCT l_orderkey) AS opinions, max(release_date) AS newest FROM lineitem JOIN opinion o ON o.id = l_orderkey GROUP BY ALL", "opinion")
def statute_detail_counts(spark, d):
    li, op = tables(spark, d, "lineitem", "opinion")
    rows = li.repartition(tasks_of(li), "l_orderkey").select((F.col("l_partkey") % 500).cast("string").alias("statute"), F.col("l_orderkey").alias("id")).join(op.select("id", "release_date"), "id")
    return rows.groupBy("statute").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("id").alias("opinions"), F.max("release_date").alias("newest"))


@query("SELECT CAST(l_partkey % 500 AS VARCHAR) AS statute, count(*) AS mentions FROM lineitem GROUP BY ALL ORDER BY mentions DESC, statute LIMIT 20")
def hot_statutes(spark, d):
    return role(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).cast("string").alias("statute")).agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.desc("mentions"), "statute").limit(20)


@query("SELECT CAST((row_number() OVER (ORDER BY court_id, case_number, id) - 1) // 1000 AS INTEGER) AS chunk, row_number() OVER (ORDER BY court_id, case_number, id) AS pos, id, 'https://x/opinion/' || replace(case_number, ' ', '%20') || '/' AS url FROM opinion", "opinion")
def sitemap_chunks(spark, d):
    return I.sitemap_chunks(role(spark, d, "opinion"), "https://x/opinion/", 1000)


# --- scalars ----------------------------------------------------------------------------------------------------------------------

@query(f"SELECT id, {CANON_SQL} AS canonical, {CANON_SQL} <> trim(case_number) AS normalizable FROM opinion", "opinion")
def canonical_case_numbers(spark, d):
    c = F.col("case_number")
    return role(spark, d, "opinion").select("id", S.canonical_case_number(c).alias("canonical"), S.is_normalizable(c).alias("normalizable"))


@query("SELECT id, CASE WHEN regexp_matches(upper(trim(case_number)), '^[A-Z][0-9]{2}-?[0-9]{4}$') THEN substr(upper(trim(case_number)), 1, 3) || '-' || right(trim(case_number), 4) ELSE upper(trim(case_number)) END AS docket, nullif(regexp_extract(case_number, '(?i)^([12])[\\s-]*CA', 1), '') AS division FROM opinion", "opinion")
def docket_numbers(spark, d):
    c = F.col("case_number")
    return role(spark, d, "opinion").select("id", S.normalize_docket(c).alias("docket"), S.appeals_division(c).alias("division"))


@query("SELECT id, CASE WHEN base IS NULL THEN name ELSE base END || CASE WHEN division = '' THEN '' WHEN state_code = 'LA' THEN ' 1st Cir.' ELSE ' Div. ' || division END AS label, lower(level) AS level_slug FROM (SELECT *, CASE state_code WHEN 'MN' THEN 'Minn.' WHEN 'AZ' THEN 'Ariz.' WHEN 'LA' THEN 'La.' WHEN 'NH' THEN CASE WHEN level = 'SUPREME' THEN 'N.H.' END END || CASE WHEN level = 'APPEALS' THEN ' Ct. App.' ELSE '' END AS base FROM court)", "court")
def court_labels(spark, d):
    return role(spark, d, "court").select("id", S.court_label(F.col("state_code"), F.col("level"), F.col("division"), F.col("name")).alias("label"), F.lower("level").alias("level_slug"))


@query("""SELECT id, title || CASE WHEN reporter_cite <> '' THEN ', ' || reporter_cite || ' (' || d || ').' ELSE ', No. ' || case_number || ' (N.H. ' || d || ').' END AS bluebook, title || ', ' || CASE WHEN reporter_cite <> '' THEN reporter_cite ELSE 'No. ' || case_number END AS plain
    FROM (SELECT *, ['Jan.', 'Feb.', 'Mar.', 'Apr.', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(release_date)] || ' ' || day(release_date) || ', ' || year(release_date) AS d FROM opinion)""", "opinion")  # fmt: skip
def bluebook_cites(spark, d):
    t, c, n, r = (F.col(x) for x in ("title", "reporter_cite", "case_number", "release_date"))
    return role(spark, d, "opinion").select("id", S.bluebook(t, c, n, r).alias("bluebook"), S.plain_cite(t, c, n).alias("plain"))


@query("SELECT id, regexp_replace(regexp_replace(full_name, ' (Jr\\.|III)$', ''), '^.* ', '') AS surname, lower(replace(full_name, '.', '')) AS name_key, trim(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM judge", "judge")
def judge_names(spark, d):
    n = F.col("full_name")
    return role(spark, d, "judge").select("id", S.surname(n).alias("surname"), S.name_key(n).alias("name_key"), S.slugify(n).alias("slug"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def sha_dedupe(spark, d):
    return role(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '-' WHEN event_id % 2 = 0 THEN '10.' || user_id % 256 || '.7.0/24' ELSE '2001:db8:' || user_id || '::/48' END AS network FROM events")
def client_networks(spark, d):
    header = F.expr("CASE WHEN event_id % 7 = 0 THEN 'unknown' WHEN event_id % 2 = 0 THEN concat('10.', user_id % 256, '.7.9, 1.1.1.1') ELSE concat('2001:db8:', user_id, '::1') END")
    return role(spark, d, "events").select("event_id", S.client_network(header).alias("network"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def strip_markup_pages(spark, d):
    return role(spark, d, "pages").select("page_id", S.strip_markup(F.col("html")).alias("text"))


@query("SELECT o_orderkey AS id, 'A' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS case_number, make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) AS iso_date, 'ctappub' AS category FROM orders")
def url_parse_manifest(spark, d):
    """All orders; a year of two digits is read as 20xx."""
    url = F.format_string("https://x/law-library-stat/archive/ctappub/OPa%02d%04d-%s.pdf", F.col("o_orderkey") % 100, F.col("o_orderkey") % 10000, F.date_format("o_orderdate", "MMddyy"))
    parts = S.archive_url(F.col("url"))
    return role(spark, d, "orders").select(F.col("o_orderkey").alias("id"), url.alias("url")).select("id", *[c.alias(n) for n, c in parts.items()])


# --- search -------------------------------------------------------------------------------------------------------------------------

TOKENS_SQL = "list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'))"


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOKENS_SQL}, 'and')")
def keyword_and_search(spark, d):
    return Q.match_all(role(spark, d, "documents"), "and of the", key="doc_id").select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({TOKENS_SQL}, 'and') AND list_contains({TOKENS_SQL}, 'ing')")
def inverted_index_search(spark, d):
    return Q.match_index(Q.inverted_index(role(spark, d, "documents"), key="doc_id"), "and ing", key="doc_id")


PHRASES = ("in the", "of the", "to the", "que de", "der die", "no such words")


@query(f"""WITH c AS (SELECT p AS tag, count(*) FILTER (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])' || p || '($|[^\\p{{L}}\\p{{N}}_])')) AS n FROM documents, (SELECT unnest({list(PHRASES)!r}) AS p) GROUP BY p), s AS (SELECT min(n) AS lo, greatest(max(n) - min(n), 1) AS span FROM c WHERE n > 0)
    SELECT tag, n, ['xs', 'sm', 'md', 'lg', 'xl'][least(CAST(floor((n - lo) / span * 5) AS INTEGER), 4) + 1] AS size, CAST(row_number() OVER (ORDER BY n DESC, lower(tag)) AS INTEGER) AS pos FROM c, s WHERE n > 0""")  # fmt: skip
def phrase_tag_cloud(spark, d):
    return Q.tag_cloud(Q.phrase_counts(role(spark, d, "documents"), PHRASES))


@query("SELECT doc_id, '&hellip; ' || regexp_replace(replace(replace(replace(trim(regexp_replace(substr(text, greatest(1, instr(lower(text), 'tion') - 80), 240), '\\s+', ' ', 'g')), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(tion)', '<mark>\\1</mark>', 'g') || ' &hellip;' AS snippet FROM documents WHERE instr(lower(text), 'tion') > 0")
def search_snippets(spark, d):
    return role(spark, d, "documents").select("doc_id", Q.snippet(F.col("text"), "tion").alias("snippet")).where("snippet IS NOT NULL")


@query("SELECT id, case_number FROM opinion WHERE contains(lower(case_number), 'ca-cv 09-1') OR contains(lower(title), '00012')", "opinion")
def substring_search(spark, d):
    op = role(spark, d, "opinion")
    return Q.substring_match(op, "CA-CV 09-1", ("case_number",)).union(Q.substring_match(op, "00012", ("title",))).distinct().select("id", "case_number")


COS_SQL = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
VEC_SQL = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"WITH {VEC_SQL} SELECT v.vec_id, round(1 - {COS_SQL.format(a='v.e', b='q.e')}, 6) AS distance FROM v, (SELECT e FROM v WHERE vec_id = 7) q ORDER BY distance, vec_id LIMIT 10")
def semantic_topk(spark, d):
    emb = role(spark, d, "embeddings")
    return Q.nearest(emb, emb.where("vec_id = 7").first().embedding, key="vec_id")


@query(f"""WITH {VEC_SQL}, x AS (SELECT vec_id, e, DATE '1995-01-01' + CAST(vec_id * 10 AS INTEGER) AS release_date FROM v) SELECT q.vec_id AS source_id, x.vec_id, round(1 - {COS_SQL.format(a='x.e', b='q.e')}, 6) AS distance,
    CAST(least(100, greatest(0, round_even((1 - round(1 - {COS_SQL.format(a='x.e', b='q.e')}, 6)) * 100, 0))) AS INTEGER) AS similarity_pct FROM x, (SELECT * FROM x WHERE vec_id = 7) q WHERE x.vec_id <> 7 AND x.release_date BETWEEN q.release_date - 1095 AND q.release_date + 1095 ORDER BY distance, x.vec_id LIMIT 5""")  # fmt: skip
def similar_items_window(spark, d):
    items = role(spark, d, "embeddings").withColumn("release_date", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") * 10).cast("int")))
    return Q.similar_items(items, items.where("vec_id = 7"), key="vec_id")


@query(f"""WITH {VEC_SQL}, i AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS x FROM i GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS t FROM m GROUP BY label),
    s AS (SELECT vec_id, CAST(c.label AS VARCHAR) AS tag_slug, {COS_SQL.format(a='e', b='t')} AS exact FROM v, c), r AS (SELECT *, round(exact, 6) AS confidence FROM s WHERE exact > 0.25), p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, tag_slug) AS pos FROM r)
    SELECT vec_id, tag_slug, confidence, CASE WHEN exact >= 0.40 THEN 'auto_applied' ELSE 'pending' END AS status, CAST(pos AS INTEGER) AS pos FROM p WHERE pos <= 5""")  # fmt: skip
def tag_suggestions(spark, d):
    emb = role(spark, d, "embeddings")
    tags = Q.centroids(emb, "label").select(F.col("label").cast("string").alias("slug"), "embedding")
    return Q.tag_suggestions(emb, tags, key="vec_id")


# --- extraction -----------------------------------------------------------------------------------------------------------------------

RENDERED = {
    "MN": "'Under Minn. Stat. § ' || (100 + id % 800) || '.' || (1 + id % 99) || ', subd. ' || (1 + id % 9) || ', the appeal fails. See State v. Doe, ' || (100 + id % 900) || ' N.W.2d ' || (1 + id % 999) || ' (Minn. 1999).'",
    "NH": "'Under RSA ' || (100 + id % 800) || '-A:' || (1 + id % 99) || ', III, the appeal fails. See In re Doe, 2024 N.H. ' || (1 + id % 99) || '.'",
    "AZ": "'Under A.R.S. § ' || (1 + id % 48) || '-' || (100 + id % 900) || '(A), relief fails. See State v. Doe, ' || (1 + id % 255) || ' Ariz. ' || (1 + id % 599) || '.'",
    "LA": "'Under La. R.S. ' || (1 + id % 56) || ':' || (10 + id % 900) || '(A), relief fails. See State v. Doe, ' || (100 + id % 900) || ' So.2d ' || (1 + id % 1300) || '.'",
}
SLUGS = {
    "MN": "'minn.stat.' || (100 + id % 800) || '.' || (1 + id % 99) || '.subd.' || (1 + id % 9)", "NH": "'rsa.' || (100 + id % 800) || '-a.' || (1 + id % 99) || '.iii'",
    "AZ": "'ars.' || (1 + id % 48) || '-' || (100 + id % 900) || '.a'", "LA": "'la.rs.' || (1 + id % 56) || '-' || (10 + id % 900) || '.a'",
}
CITED = {
    "MN": "(100 + id % 900) || ' N.W.2d ' || (1 + id % 999)", "NH": "'2024 N.H. ' || (1 + id % 99)", "AZ": "(1 + id % 255) || ' Ariz. ' || (1 + id % 599)", "LA": "(100 + id % 900) || ' So. 2d ' || (1 + id % 1300)",
}


def by_state(parts: dict[str, str]) -> str:
    return "CASE id % 4 " + " ".join(f"WHEN {k} THEN {parts[s]}" for k, s in enumerate(("MN", "NH", "AZ", "LA"))) + " END"


STATE_SQL = by_state({s: f"'{s}'" for s in RENDERED})


#: Opinions that one task reads through.
READ_AT_ONCE = 50_000


def dealt(spark, d) -> DataFrame:
    """The ids of the opinions, dealt to all cores (the test tables are a few row groups each) and to more tasks as they grow."""
    most = -(-role(spark, d, "orders").count() // READ_AT_ONCE)  # an opinion is an order
    return role(spark, d, "opinion").select("id").repartition(max(spark.sparkContext.defaultParallelism, most))


def rendered(spark, d) -> DataFrame:
    """Citation-shaped texts of the opinions, of a state each."""
    return dealt(spark, d).select("id", F.expr(STATE_SQL).alias("state_code"), F.expr(by_state(RENDERED)).alias("raw_text"), F.lit("").alias("self_cite"))


@query(f"SELECT id, {by_state(SLUGS)} AS reference_slug, 6 AS text_offset FROM opinion", "opinion")
def statute_mentions(spark, d):
    return T.extract_statutes(rendered(spark, d)).select("id", "reference_slug", "text_offset")


NATIVE = {"MN": r"Minn\. Stat\. § \d+\.\d+", "NH": r"RSA \d+-[A-Z]:\d+", "AZ": r"A\.R\.S\. § \d+-\d+", "LA": r"La\. R\.S\. \d+:\d+"}
NATIVE_SQL = {
    "MN": "'Minn. Stat. § ' || (100 + id % 800) || '.' || (1 + id % 99)", "NH": "'RSA ' || (100 + id % 800) || '-A:' || (1 + id % 99)",
    "AZ": "'A.R.S. § ' || (1 + id % 48) || '-' || (100 + id % 900)", "LA": "'La. R.S. ' || (1 + id % 56) || ':' || (10 + id % 900)",
}


@query(f"SELECT id, {by_state(NATIVE_SQL)} AS found, 6 AS at FROM opinion", "opinion")
def statute_mentions_native(spark, d):
    found = F.coalesce(*[F.when(F.col("state_code") == s, T.native_offsets(F.col("raw_text"), p)) for s, p in NATIVE.items()])
    return rendered(spark, d).select("id", F.inline(found))


@query(f"SELECT id, {by_state(CITED)} AS reporter_cite, CAST(instr({by_state(RENDERED)}, CASE WHEN id % 4 = 3 THEN replace({by_state(CITED)}, 'So. 2d', 'So.2d') ELSE {by_state(CITED)} END) - 1 AS INTEGER) AS text_offset FROM opinion", "opinion")
def case_cites_extracted(spark, d):
    return T.extract_cites(rendered(spark, d)).select("id", "reporter_cite", "text_offset")


TREATMENT_SQL = "CASE " + " ".join(f"WHEN contains(context, '{w}') THEN '{t}'" for w, t in (("overrule", "OVERRULED"), ("distinguishable", "DISTINGUISHED"), ("declined to follow", "CRITICIZED"), ("we follow", "FOLLOWED"), ("as explained in", "EXPLAINED"))) + " ELSE 'CITED' END"


@query(f"SELECT {TREATMENT_SQL} AS treatment, count(*) AS n FROM edge GROUP BY ALL", "edge")
def treatment_mix(spark, d):
    return G.treatment_mix(role(spark, d, "edge").withColumn("treatment", G.treatment(F.col("context"))))


# --- the graph ------------------------------------------------------------------------------------------------------------------------

MAP_SQL = f"""m AS (SELECT cite, arg_min(opinion_id, (prio, release_date, opinion_id)) AS opinion_id FROM (
    SELECT reporter_cite AS cite, id AS opinion_id, release_date, 0 AS prio FROM opinion WHERE reporter_cite <> ''
    UNION ALL SELECT cite, min(id), min(release_date), 2 FROM (SELECT {CANON_SQL} AS cite, id, release_date FROM opinion) WHERE cite <> '' GROUP BY cite HAVING count(*) = 1) GROUP BY cite)"""
EDGE_SQL = f"""{MAP_SQL}, j AS (SELECT citing_id, cite, context, opinion_id AS cited_id FROM edge LEFT JOIN m USING (cite)), k AS (SELECT citing_id, coalesce(CAST(cited_id AS VARCHAR), '?' || cite) AS target, arg_min({{'cite': cite, 'context': context, 'cited_id': cited_id}}, (cite, context)) AS b FROM j WHERE cited_id IS NULL OR cited_id <> citing_id GROUP BY ALL),
    r AS (SELECT citing_id, b.cited_id AS cited_id, b.cite AS cite, b.context AS context FROM k)"""


def edges(spark, d) -> DataFrame:
    return G.resolve_edges(role(spark, d, "edge"), G.cite_map(role(spark, d, "opinion")))


@query(f"WITH {MAP_SQL} SELECT cite, opinion_id FROM m", "opinion")
def cite_resolution_map(spark, d):
    return G.cite_map(role(spark, d, "opinion"))


@query(f"WITH {EDGE_SQL} SELECT citing_id, cited_id, cite, context, {TREATMENT_SQL} AS treatment FROM r", "opinion", "edge")
def citation_edges_resolved(spark, d):
    return edges(spark, d)


@query(f"WITH {EDGE_SQL} SELECT cited_id, count(*) AS edge_count, count(DISTINCT citing_id) AS citing_count FROM r WHERE cited_id IS NOT NULL GROUP BY ALL", "opinion", "edge")
def cited_by_counts(spark, d):
    return G.cited_by(edges(spark, d))


@query(f"WITH {EDGE_SQL}, t AS (SELECT cited_id, count(*) AS edge_count, count(DISTINCT citing_id) AS citing_count FROM r WHERE cited_id IS NOT NULL GROUP BY ALL ORDER BY citing_count DESC, cited_id LIMIT 10) SELECT cited_id, title, citing_count, edge_count FROM t JOIN opinion o ON o.id = cited_id", "opinion", "edge")
def top_cited_opinions(spark, d):
    return G.top_cited(edges(spark, d), role(spark, d, "opinion"))


@query(f"WITH {MAP_SQL}, j AS (SELECT DISTINCT citing_id, opinion_id AS cited_id, cite, source FROM edge LEFT JOIN m USING (cite)), k AS (SELECT *, row_number() OVER (PARTITION BY citing_id, cited_id ORDER BY CASE WHEN source = 'extracted' THEN 0 ELSE 1 END, cite) AS rn FROM j WHERE cited_id IS NOT NULL) SELECT citing_id, cited_id, cite, source FROM k WHERE rn = 1 UNION ALL SELECT citing_id, cited_id, cite, source FROM j WHERE cited_id IS NULL", "opinion", "edge")
def prefer_extracted_edges(spark, d):
    mapped = role(spark, d, "edge").drop("context").distinct().join(G.cite_map(role(spark, d, "opinion")).withColumnRenamed("opinion_id", "cited_id"), "cite", "left")
    return G.prefer_extracted(mapped).select("citing_id", "cited_id", "cite", "source")


@query(f"WITH {EDGE_SQL}, x AS (SELECT cited_id FROM r WHERE cited_id IS NOT NULL GROUP BY ALL ORDER BY count(DISTINCT citing_id) DESC, cited_id LIMIT 1) SELECT id, title, release_date FROM opinion WHERE id IN (SELECT citing_id FROM r JOIN x USING (cited_id)) ORDER BY release_date DESC, id LIMIT 5 OFFSET 5", "opinion", "edge")
def cited_by_page(spark, d):
    op = role(spark, d, "opinion")
    pairs = G.citing_pairs(role(spark, d, "edge", {"lineitem": "l_orderkey"}), G.cite_map(op))
    top = G.most_cited(pairs)
    return G.cited_by_page(pairs, op, -1 if top is None else top, page=2, size=5)


@query()
def passage_clusters(spark, d):
    return G.greedy_clusters(passages(spark, d))


@query()
def cited_how_panel(spark, d):
    p = passages(spark, d)
    return G.cited_how(p, G.greedy_clusters(p))


def passages(spark, d) -> DataFrame:
    emb = role(spark, d, "embeddings")
    return emb.select(F.col("vec_id").alias("edge_id"), F.col("label").cast("long").alias("cited_id"), F.date_add(F.lit("1999-01-01").cast("date"), (F.col("vec_id") % 400).cast("int")).alias("release_date"), (F.col("vec_id") % 1000).cast("int").alias("text_offset"), F.when(F.col("vec_id") % 5 == 0, "").otherwise(F.repeat(F.lit("q"), (F.col("vec_id") % 60).cast("int"))).alias("quote"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("vector"))


# --- resolution -----------------------------------------------------------------------------------------------------------------------

@query(f"WITH r AS (SELECT id, court_id, case_number, {CANON_SQL} AS canonical FROM opinion), w AS (SELECT *, count(*) OVER (PARTITION BY court_id, canonical) AS n FROM r WHERE canonical <> trim(case_number)) SELECT id, court_id, case_number, canonical, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.court_id = w.court_id AND r.case_number = w.canonical) THEN 'collision' WHEN n > 1 THEN 'internal' ELSE 'rename' END AS action FROM w", "opinion")
def docket_rename_plan(spark, d):
    return R.rename_plan(role(spark, d, "opinion"))


LOOKUP_SQL = """a AS (SELECT DISTINCT docket, want_level, want_date FROM q), v AS (SELECT DISTINCT docket, want_level, want_date, unnest(CASE WHEN starts_with(lower(docket), 'no.') THEN [docket, c] ELSE [docket, c, 'No. ' || docket, 'No. ' || c] END) AS variant FROM (SELECT *, {canon} AS c FROM a)),
    h AS (SELECT DISTINCT docket, want_level, want_date, o.id AS opinion_id, release_date, CASE level WHEN 'SUPREME' THEN 0 ELSE 1 END AS rank, CASE WHEN want_date = release_date AND (want_level = '' OR lower(level) = want_level) THEN 0 WHEN want_level <> '' AND lower(level) = want_level THEN 1 ELSE 2 END AS tier FROM v JOIN opinion o ON o.case_number = variant JOIN court c ON c.id = o.court_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY docket, want_level, want_date ORDER BY tier, CASE WHEN tier = 2 THEN rank ELSE 0 END, release_date DESC, CASE WHEN tier = 1 THEN -opinion_id ELSE opinion_id END) AS rn FROM h)
    SELECT request_id, q.docket, opinion_id, release_date FROM q JOIN b ON b.docket = q.docket AND b.want_level = q.want_level AND b.want_date IS NOT DISTINCT FROM q.want_date WHERE rn = 1""".format(canon=CANON_SQL.replace("case_number", "docket"))  # fmt: skip


@query(f"WITH q AS (SELECT id AS request_id, {CANON_SQL} AS docket, CASE id % 3 WHEN 1 THEN 'appeals' ELSE '' END AS want_level, CASE id % 3 WHEN 2 THEN release_date END AS want_date FROM opinion), " + LOOKUP_SQL, "opinion", "court")
def docket_lookup_pick(spark, d):
    """The docket of every opinion is a request: a third with a wish for a level, a third with a date."""
    op, courts = tables(spark, d, "opinion", "court")
    level, date = F.when(F.col("id") % 3 == 1, "appeals").otherwise(""), F.when(F.col("id") % 3 == 2, F.col("release_date"))
    asked = op.select(F.col("id").alias("request_id"), S.canonical_case_number(F.col("case_number")).alias("docket"), level.alias("want_level"), date.alias("want_date"))
    return R.docket_lookup(asked, op, courts)


@query(f"WITH q AS (SELECT id AS request_id, {CANON_SQL} AS docket, '' AS want_level, CAST(NULL AS DATE) AS want_date FROM opinion), " + LOOKUP_SQL, "opinion", "court")
def docket_lookup_all(spark, d):
    """The docket of every opinion is a request, without a wish."""
    op, courts = tables(spark, d, "opinion", "court")
    asked = op.select(F.col("id").alias("request_id"), S.canonical_case_number(F.col("case_number")).alias("docket"), F.lit("").alias("want_level"), F.lit(None).cast("date").alias("want_date"))
    return R.docket_lookup(asked, op, courts)


DUP_JUDGE = "CASE WHEN id % 10 = 3 THEN 'Judge Supplier#' || lpad(CAST(id - 3 AS STRING), 9, '0') WHEN id % 10 = 4 THEN 'Supplier#' || lpad(CAST(id + 1 AS STRING), 9, '0') ELSE 'Judge Supplier#' || lpad(CAST(id AS STRING), 9, '0') END"
SCORE = "CAST(CASE WHEN bio_summary <> '' THEN 4 ELSE 0 END + CASE WHEN is_currently_seated THEN 4 ELSE 0 END + CASE WHEN appointment_date IS NOT NULL THEN 1 ELSE 0 END + 1 AS INTEGER)"
PLAN_SQL = f"""n AS (SELECT judge_id, count(*) AS votes FROM vote GROUP BY ALL), g AS (SELECT j.id, coalesce(votes, 0) AS votes, {SCORE} AS score, lower({DUP_JUDGE.replace('id ', 'j.id ').replace('(id', '(j.id')}) AS key FROM judge j LEFT JOIN n ON judge_id = j.id), h AS (SELECT *, regexp_replace(key, '^.* ', '') AS surname FROM g),
    e AS (SELECT key, arg_max(id, (score, votes, -id)) AS survivor FROM h GROUP BY key HAVING count(*) > 1), x AS (SELECT id AS loser, survivor, 'name' AS why FROM h JOIN e USING (key) WHERE id <> survivor),
    f AS (SELECT surname, arg_max(id, (score, votes, -id)) AS survivor FROM h WHERE key <> surname GROUP BY surname HAVING count(DISTINCT key) = 1), pl AS (SELECT * FROM x UNION ALL SELECT h.id, f.survivor, 'surname' FROM h JOIN f USING (surname) WHERE key = surname AND h.id NOT IN (SELECT loser FROM x))"""


def judge_plan(spark, d) -> DataFrame:
    judges, votes = tables(spark, d, "judge", "vote")
    return R.judge_merge_plan(judges.withColumns({"full_name": F.expr(DUP_JUDGE), "state_code": F.lit("MN"), "score": F.expr(SCORE)}), votes)


@query(f"WITH {PLAN_SQL} SELECT loser, survivor, why FROM pl", "judge", "vote")
def judge_merge_plan(spark, d):
    return judge_plan(spark, d)


RANK_SQL = "CASE vote_type " + " ".join(f"WHEN '{v}' THEN {r}" for v, (r, _) in VOTES.items()) + " END"


@query(f"WITH {PLAN_SQL} SELECT opinion_id, coalesce(survivor, judge_id) AS judge_id, arg_max(vote_type, {RANK_SQL}) AS vote_type FROM vote LEFT JOIN pl ON loser = judge_id GROUP BY ALL", "judge", "vote")
def vote_merge(spark, d):
    return R.merge_votes(role(spark, d, "vote"), judge_plan(spark, d).drop("why"))


@query(f"WITH r AS (SELECT id, court_id, DATE '1999-01-01' AS release_date, id % 13 AS size, {CANON_SQL} AS docket FROM opinion), s AS (SELECT court_id, docket, release_date, arg_max(id, (size, -id)) AS survivor FROM r GROUP BY ALL HAVING count(*) > 1) SELECT id AS loser, survivor FROM r JOIN s USING (court_id, docket, release_date) WHERE id <> survivor", "opinion")
def opinion_merge_plan(spark, d):
    op = role(spark, d, "opinion").withColumns({"size": F.col("id") % 13, "title": F.lit("State v. Doe"), "release_date": F.lit("1999-01-01").cast("date")})
    return R.opinion_merge_plan(op)


@query("SELECT judge_id, CASE WHEN count(*) FILTER (id % 12 = 4) >= count(*) FILTER (id % 12 <> 4) THEN '1' ELSE '2' END AS division FROM vote JOIN opinion o ON o.id = opinion_id WHERE id % 6 = 4 GROUP BY judge_id", "vote", "opinion")
def majority_division(spark, d):
    op = role(spark, d, "opinion").withColumn("case_number", F.expr("CASE WHEN id % 6 = 4 THEN CASE WHEN id % 12 = 4 THEN 'No. 1 CA-CV 9' ELSE '2-CA-CR 7' END ELSE case_number END"))
    return R.majority_division(role(spark, d, "vote"), op)


@query("WITH j AS (SELECT s_suppkey AS k, s_name AS old_name, s_acctbal > 3000 AS seated FROM supplier WHERE s_suppkey % 5 <> 0), r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 0 THEN upper(s_name) ELSE s_name END AS new_name FROM supplier WHERE s_suppkey % 7 <> 0) SELECT CAST(k AS VARCHAR) AS source_id, old_name, new_name, CASE WHEN old_name IS NULL THEN 'new' WHEN new_name IS NULL THEN CASE WHEN seated THEN 'gone' ELSE 'same' END WHEN old_name = new_name AND seated THEN 'same' ELSE 'changed' END AS action FROM j FULL JOIN r USING (k)")
def roster_upsert_diff(spark, d):
    s = role(spark, d, "supplier")
    judges = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("source_id"), F.col("s_name").alias("full_name"), (F.col("s_acctbal") > 3000).alias("is_currently_seated"))
    roster = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").cast("string").alias("source_id"), F.expr("CASE WHEN s_suppkey % 9 = 0 THEN upper(s_name) ELSE s_name END").alias("full_name"))
    return R.roster_diff(judges, roster)


# --- loading --------------------------------------------------------------------------------------------------------------------------

@query("""WITH dk AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7, 11)), cl AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM dk)), op AS (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM cl)), pe AS (SELECT DISTINCT l_suppkey AS k FROM op UNION SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7, 11))
    SELECT 'dockets' AS tbl, count(*) AS n FROM dk UNION ALL SELECT 'clusters', count(*) FROM cl UNION ALL SELECT 'opinions', count(*) FROM op UNION ALL SELECT 'panel', count(*) FROM op UNION ALL SELECT 'positions', count(*) FROM supplier WHERE s_suppkey IN (SELECT k FROM pe) UNION ALL SELECT 'people', count(*) FROM supplier WHERE s_suppkey IN (SELECT k FROM pe)""")  # fmt: skip
def fk_cascade_subset(spark, d):
    c, o, li, s = tables(spark, d, "customer", "orders", "lineitem", "supplier")
    col = lambda df, **names: df.select(*[F.col(v).alias(k) for k, v in names.items()])
    kept = I.fk_cascade(
        {"dockets": c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("court_id")), "clusters": col(o, id="o_orderkey", docket_id="o_custkey"), "opinions": col(li, id="l_partkey", cluster_id="l_orderkey"),
         "panel": col(li, opinioncluster_id="l_orderkey", person_id="l_suppkey"), "positions": s.select(F.col("s_suppkey").alias("person_id"), F.col("s_nationkey").cast("string").alias("court_id")), "people": col(s, id="s_suppkey")}, ("3", "7", "11"))
    out = None
    for name, df in kept.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n")
        out = row if out is None else out.unionByName(row)
    return out


BEST_SQL = "SELECT doc_id AS id, doc_id // 5 AS cluster_id, CASE doc_id % 5 WHEN 0 THEN '040dissent' WHEN 1 THEN '010combined' WHEN 2 THEN '020lead' WHEN 3 THEN '030concurrence' ELSE 'x' END AS type, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text FROM documents"


@query(f"WITH r AS ({BEST_SQL}) SELECT cluster_id, id, type, text FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE type WHEN '020lead' THEN 0 WHEN '010combined' THEN 1 WHEN '030concurrence' THEN 4 WHEN '040dissent' THEN 5 ELSE 99 END, id) AS rn FROM r WHERE trim(text) <> '') WHERE rn = 1")
def best_text_per_cluster(spark, d):
    rows = role(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("cluster_id"), F.expr("CASE doc_id % 5 WHEN 0 THEN '040dissent' WHEN 1 THEN '010combined' WHEN 2 THEN '020lead' WHEN 3 THEN '030concurrence' ELSE 'x' END").alias("type"), F.expr("CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END").alias("plain_text"), F.col("doc_id").alias("seq"), *[F.lit("").alias(c) for c in I.TEXT_FALLBACK])
    return I.best_text(rows)


@query("WITH n AS (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), o AS (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL) SELECT coalesce(n.k, o.k) AS k, CAST(coalesce(n.d, o.d) AS DATE) AS day FROM n FULL JOIN o ON n.k = o.k")
def upsert_latest(spark, d):
    rows = role(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey")
    return I.upsert(rows.where("o_orderkey % 3 <> 0").drop("o_orderkey"), rows.where("o_orderkey % 3 = 0").drop("o_orderkey"), ("k",), "day")


@query("SELECT doc_id AS id, CASE WHEN contains(text, chr(12)) THEN 'has pages' WHEN doc_id % 4 = 3 THEN 'nothing' WHEN doc_id % 4 = 2 AND length(text) > 0 THEN CASE WHEN floor(length(text) / 2.0) / length(text) BETWEEN 0.7 AND 2.0 THEN 'restore' ELSE 'ratio' END ELSE 'restore' END AS action FROM documents")
def page_restore_gate(spark, d):
    docs = role(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    new = docs.where("id % 4 <> 3").select("id", F.lit("020lead").alias("type"), F.expr("CASE WHEN id % 4 = 2 THEN left(text, cast(floor(length(text) / 2) AS INT)) ELSE text END").alias("plain_text"), F.lit(0).alias("seq"))
    return I.restore_pages(docs, new).select("id", "action")


@query(f"SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-06-02' OR o_orderkey % 50 = 0")
def future_date_reject(spark, d):
    rows = role(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("date").cast("string")).alias("date_filed"))
    return I.reject_future(rows, "1999-06-01").select("id")


# --- logs ------------------------------------------------------------------------------------------------------------------------------

@query("""WITH b AS (SELECT CASE WHEN regexp_matches(path, '^/opinion/.*/cited-by/?$') THEN '/opinion/<X>/cited-by/' WHEN starts_with(path, '/opinion/') THEN '/opinion/<X>/' WHEN starts_with(path, '/judge/') THEN '/judge/<X>/' WHEN starts_with(path, '/statute/') THEN '/statute/<X>/' ELSE '/sitemap*.xml' END AS shape, count(*) AS n FROM log WHERE status BETWEEN 500 AND 599 GROUP BY ALL),
    t AS (SELECT count(*) AS requests, count(*) FILTER (status BETWEEN 500 AND 599) AS errors FROM log) SELECT shape, n, requests, errors, round(100.0::DOUBLE * errors / requests, 3) AS rate, errors >= 20 OR 100.0 * errors / requests >= 1 AS alert FROM b, t""", "log")  # fmt: skip
def error_rate_by_shape(spark, d):
    return L.error_rate(log_lines(spark, d))


def log_lines(spark, d) -> DataFrame:
    """The log as lines of text, read back by the parser."""
    log = role(spark, d, "log")
    line = F.format_string('host [%s:10:00:00 +0000] "GET %s HTTP/1.1" %d 12 "%s"', F.date_format("day", "d/MMM/yyyy"), "path", "status", "agent")
    return L.parse_lines(log.select(line.alias("value")))


@query("SELECT day, path, CAST(status AS INTEGER) AS status, agent FROM log", "log")
def access_log_parse(spark, d):
    return log_lines(spark, d)


@query(f"""WITH h AS (SELECT regexp_extract(path, '^/opinion/(.+?)/?$', 1) AS case_number, count(*) AS hits FROM log WHERE status = 200 AND day BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' AND (contains(lower(agent), 'chatgpt-user') OR contains(lower(agent), 'claude-user')) AND starts_with(path, '/opinion/') GROUP BY ALL),
    o AS (SELECT case_number, arg_min({{'court_id': court_id, 'release_date': release_date, 'disposition': disposition}}, (release_date, id)) AS o FROM opinion GROUP BY ALL), r AS (SELECT hits, o.court_id AS court_id, o.release_date AS release_date, o.disposition AS disposition FROM h LEFT JOIN o USING (case_number)), k AS (SELECT r.*, state_code, level FROM r LEFT JOIN court c ON c.id = r.court_id),
    f AS (SELECT 'matched' AS facet, CASE WHEN release_date IS NULL THEN 'no' ELSE 'yes' END AS value, hits FROM k UNION ALL SELECT 'state', state_code, hits FROM k WHERE release_date IS NOT NULL UNION ALL SELECT 'level', level, hits FROM k WHERE release_date IS NOT NULL
          UNION ALL SELECT 'decade', CAST(year(release_date) // 10 * 10 AS VARCHAR), hits FROM k WHERE release_date IS NOT NULL UNION ALL SELECT 'outcome', {outcome_sql()}, hits FROM k WHERE release_date IS NOT NULL)
    SELECT facet, value, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS cases FROM f GROUP BY ALL""", "log", "opinion", "court")  # fmt: skip
def agent_profile(spark, d):
    return L.agent_profile(*tables(spark, d, "log", "opinion", "court"), "2024-01-20")


@query("SELECT CASE WHEN contains(lower(agent), 'gptbot') THEN 'training' ELSE 'live' END AS kind, path, count(*) AS n FROM log WHERE NOT contains(agent, 'X11') GROUP BY ALL ORDER BY n DESC, kind, path LIMIT 15", "log")
def agent_traffic(spark, d):
    return L.agent_traffic(role(spark, d, "log"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def hourly_events(spark, d):
    from lexlake.streaming.pipelines import hourly

    return hourly(role(spark, d, "events"))


@query()
def parse_opinions(spark, d):
    return T.parse_opinions(rendered(spark, d)).select("id", "case_number", "disposition", "is_precedential", F.size("statutes_cited").alias("statutes"), F.size("citations_to").alias("cites"))


@query("SELECT id, 'We hold that rule ' || id || ' of the code controls the question on appeal.' AS text, 1 AS paragraph, 'hold' AS signal, 11 AS collapsed_offset FROM opinion", "opinion")
def holdings(spark, d):
    docs = role(spark, d, "opinion").select("id", F.concat(F.lit("[¶1] Facts. We hold that rule "), "id", F.lit(" of the code controls the question on appeal. We conclude otherwise.")).alias("raw_text"), F.lit("").alias("holding_summary"), F.lit("").alias("review_status"))
    return T.extract_holdings(docs)


WRITERS = ("smith", "larkin", "o'brien", "bjorkman")
BYLINE_SHAPES = ("'STATE OF MINNESOTA\\n{n}, Judge\\nThe appeal fails.'", "'Justice {n} authored the opinion of the Court, in which Justices Lopez and King joined.\\nMore.'", "'COURT OF APPEAL\\n\\n{n}, J.\\n\\nThe facts.'")


@query(f"SELECT id, [{', '.join("'" + w.replace("'", "''") + "'" for w in WRITERS)}][1 + id % 4] AS author_last FROM opinion", "opinion")
def bylines(spark, d):
    """Four writers in the bylines of three states."""
    name = F.upper(F.get(F.array(*map(F.lit, WRITERS)), (F.col("id") % 4).cast("int")))
    shapes = [F.concat(*[x for k, part in enumerate(t.strip("'").encode().decode("unicode_escape").split("{n}")) for x in ([name] if k else []) + [F.lit(part)]]) for t in BYLINE_SHAPES]
    docs = dealt(spark, d).select("id", F.get(F.array(*shapes), (F.col("id") % 3).cast("int")).alias("raw_text"))
    return T.extract_bylines(docs).select("id", "author_last")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN '2' WHEN id % 3 = 1 THEN '5' END AS circuit FROM opinion", "opinion")
def circuit_detect(spark, d):
    docs = dealt(spark, d).select("id", F.expr("CASE id % 3 WHEN 0 THEN 'STATE OF LOUISIANA\nCOURT OF APPEAL\nSECOND CIRCUIT' WHEN 1 THEN 'Parish of St. Charles' ELSE 'No court named' END").alias("raw_text"))
    return T.detect_circuits(docs)


@query()
def text_structure(spark, d):
    return T.text_structure(role(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text")))


# --- more of loading and resolution ------------------------------------------------------------------------------------------------------

@query("SELECT page_id, '' AS role, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS full_name FROM pages")
def roster_headings(spark, d):
    return rosters.headings(role(spark, d, "pages")).drop("slug")


@query("SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"[^\"]*\"[^>]*>')) AS a FROM pages) GROUP BY ALL")
def roster_links(spark, d):
    return rosters.links(role(spark, d, "pages"), "https://courts.example").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN CASE s_nationkey % 2 WHEN 0 THEN 'MN' ELSE 'NH' END END AS state FROM supplier")
def host_router(spark, d):
    host = F.expr("CASE s_suppkey % 3 WHEN 0 THEN concat(CASE s_nationkey % 2 WHEN 0 THEN 'mn' ELSE 'www.nh' END, '.site.org:8080') WHEN 1 THEN 'site.org' ELSE 'long.site.org' END")
    return role(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.state_of_host(host).alias("state"))


@query("SELECT id, CASE WHEN reporter_cite = '' AND n.new IS NOT NULL THEN n.new ELSE reporter_cite END AS reporter_cite FROM opinion LEFT JOIN (SELECT l_orderkey AS k, arg_max('x ' || l_partkey, l_linenumber * 1000000 + l_partkey) AS new FROM lineitem GROUP BY ALL) n ON n.k = id", "opinion")
def reporter_cite_load(spark, d):
    op, li = tables(spark, d, "opinion", "lineitem")
    mapping = li.select(F.col("l_orderkey").alias("cluster_id"), F.concat(F.lit("x "), "l_partkey").alias("reporter_cite"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("seq"))
    return R.reporter_cites(op.withColumn("cluster_id", F.col("id")), mapping).select("id", "reporter_cite")


@query("SELECT DISTINCT l_orderkey AS opinion_id, l_partkey % 90 || ' A.2d ' || l_suppkey AS cite FROM lineitem WHERE l_linenumber <> 2 AND l_orderkey IN (SELECT id FROM opinion) AND l_orderkey % 9 <> 0", "opinion")
def parallel_cite_load(spark, d):
    op, li = tables(spark, d, "opinion", "lineitem")
    rows = li.select(F.col("l_orderkey").alias("cluster_id"), F.when(F.col("l_linenumber") == 2, F.lit("2020 LEXIS 5")).otherwise(F.concat(F.col("l_partkey") % 90, F.lit(" A.2d "), "l_suppkey")).alias("cite"), F.lit("A.2d").alias("reporter"))
    old = rows.where("cluster_id % 9 = 0").select(F.col("cluster_id").alias("opinion_id"), "cite")
    return R.parallel_cites(rows, op.withColumn("cluster_id", F.col("id")), old).select("opinion_id", "cite")


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN c_nationkey ELSE 99 END AS BIGINT) AS court_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 3 = 2")
def division_rehoming(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    rows = op.join(courts.where("division = '1'").select(F.col("id").alias("court_id"), "state_code", "level", F.col("name").alias("own")), "court_id").withColumn("state_code", F.col("own"))
    places = courts.where("division = '1'").withColumn("state_code", F.col("name"))
    return R.rehome(rows, places, F.lit(99).cast("long"), F.when(F.col("id") % 5 == 0, "1")).select("id", "court_id")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 1")
def not_yet_parsed(spark, d):
    docs = role(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("MN").alias("state_code"), F.col("text").alias("raw_text"))
    log = docs.where("id % 3 = 0").select(F.col("id").alias("opinion_id"), F.lit("MN").alias("parser_state"), F.when(F.col("id") % 2 == 0, F.sha2("raw_text", 256)).otherwise("old").alias("raw_text_sha256"))
    return I.not_logged(docs, log).select("id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS new_role FROM supplier WHERE s_suppkey % 4 <> 1")
def manifest_changes(spark, d):
    s = role(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 1, "old").alias("role"))
    manifest = s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "new").alias("role"))
    return I.changed_fields(rows, manifest, ("id",), ("role",)).select("id", "new_role")


@query("SELECT CAST(count(*) AS BIGINT) AS dated, avg(CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-12-29' AND DATE '2000-01-04' THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN CAST(o_orderdate AS DATE) BETWEEN DATE '1995-12-29' AND DATE '2000-01-04' THEN 1.0 ELSE 0.0 END) >= 0.8 AS honoured FROM orders")
def window_gate(spark, d):
    rows = role(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("iso_date"))
    return I.window_honoured(rows, "1996-01-01", "2000-01-01")


@query("SELECT CAST(low AS DATE) AS low, least(CAST(low AS DATE) + 29, DATE '1996-12-31') AS high FROM range(DATE '1995-01-01', DATE '1997-01-01', INTERVAL 30 DAY) t(low)")
def window_iterator(spark, d):
    return I.windows(spark, "1995-01-01", "1996-12-31", 30)


@query(f"WITH {MAP_SQL}, o AS (SELECT citing_id, opinion_id AS cited_id FROM edge JOIN m USING (cite) WHERE source = 'bulk'), c AS (SELECT o.id AS oid, state_code FROM opinion o JOIN court c ON c.id = o.court_id) SELECT DISTINCT citing_id, cited_id FROM o JOIN c ON oid = citing_id WHERE state_code IN ('MN', 'AZ') AND citing_id <> cited_id AND citing_id % 10 <> 0", "opinion", "edge", "court")
def bulk_edge_load(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    found = role(spark, d, "edge").where("source = 'bulk'").join(G.cite_map(op), "cite").select(F.col("citing_id").alias("citing_cluster_id"), F.col("opinion_id").alias("cited_cluster_id"))
    clusters = op.join(courts.select(F.col("id").alias("court_id"), "state_code"), "court_id").select(F.col("id").alias("cluster_id"), F.col("id").alias("opinion_id"), "state_code")
    old = found.where("citing_cluster_id % 10 = 0").select(F.col("citing_cluster_id").alias("citing_id"), F.col("cited_cluster_id").alias("cited_id"))
    return G.bulk_edges(found, clusters, old)


@query("SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 12 = 0 THEN 'filled' ELSE 'corrected' END WHEN id % 12 = 0 THEN 'unchanged' ELSE 'cleared' END AS action FROM opinion", "opinion")
def disposition_backfill(spark, d):
    op = role(spark, d, "opinion")
    parsed = op.where("id % 4 = 0").select("id", F.lit("Something else").alias("disposition"), F.lit(0.9).alias("confidence"))
    return I.backfill_dispositions(op, parsed, 0.5, recompute=True).select("id", "action")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(ts) AS start FROM k GROUP BY user_id, s")
def user_sessions(spark, d):
    from lexlake.streaming.pipelines import sessions

    return sessions(role(spark, d, "events")).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("start"))


from lexlake.plans import indexes, keeping, merging, more, outputs  # noqa: E402, F401  (they register their queries)
