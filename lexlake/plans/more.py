"""More registered queries: lookups, review, vectors on file, headers of opinions. Imported by ``registry``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexlake.functions import legal_text as T
from lexlake.functions import scalars as S
from lexlake.operators import graph as G
from lexlake.operators import ingest as I
from lexlake.operators import logs as L
from lexlake.operators import lookups as K
from lexlake.operators import review as V
from lexlake.operators import search as Q
from lexlake.plans.adapters import REF_DATE, role
from lexlake.plans.registry import CANON_SQL, COS_SQL, ORACLES, TAG_SQL, VEC_SQL, by_state, outcome_sql, query, tables


def no_wish() -> tuple:
    return F.lit("").alias("want_level"), F.lit(None).cast("date").alias("want_date")



def variants_sql(docket: str) -> str:
    """The spellings of a docket, one a row."""
    canon = CANON_SQL.replace("case_number", docket)
    return f"unnest(CASE WHEN starts_with(lower({docket}), 'no.') THEN [{docket}, {canon}] ELSE [{docket}, {canon}, 'No. ' || {docket}, 'No. ' || {canon}] END)"


# --- lookups -----------------------------------------------------------------------------------------------------------------------

@query(f"""WITH b AS ({ORACLES['docket_lookup_all']}), v AS (SELECT DISTINCT docket, {variants_sql('docket')} AS variant FROM (SELECT DISTINCT docket FROM b)),
    s AS (SELECT docket, count(*) - 1 AS siblings FROM v JOIN opinion o ON o.case_number = variant GROUP BY docket)
    SELECT request_id, docket, opinion_id, release_date, siblings FROM b JOIN s USING (docket)""", "opinion")  # fmt: skip
def opinion_by_docket(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    asked = op.select(F.col("id").alias("request_id"), S.canonical_case_number(F.col("case_number")).alias("docket"), *no_wish())
    return K.opinions_by_docket(asked, op, courts)


@query(f"""WITH p AS (SELECT id AS opinion_id, '9 Parallel ' || CAST(id % 5000 AS VARCHAR) AS cite FROM opinion),
    a AS (SELECT DISTINCT cite FROM (SELECT upper(reporter_cite) AS cite FROM opinion UNION ALL SELECT lower(cite) FROM p UNION ALL SELECT case_number FROM opinion UNION ALL SELECT 'nothing' || CAST(id AS VARCHAR) FROM opinion) WHERE cite <> ''),
    r AS (SELECT lower(reporter_cite) AS key, min(id) AS r FROM opinion WHERE reporter_cite <> '' GROUP BY ALL), q AS (SELECT lower(cite) AS key, min(opinion_id) AS q FROM p GROUP BY ALL),
    m AS (SELECT cite, r, q FROM a LEFT JOIN r ON r.key = lower(cite) LEFT JOIN q ON q.key = lower(cite)), v AS (SELECT DISTINCT cite, {variants_sql('cite')} AS variant FROM m WHERE r IS NULL AND q IS NULL),
    h AS (SELECT cite, state_code, o.id, row_number() OVER (PARTITION BY cite, state_code ORDER BY CASE level WHEN 'SUPREME' THEN 0 ELSE 1 END, release_date DESC, o.id) AS rn FROM v JOIN opinion o ON o.case_number = variant JOIN court c ON c.id = o.court_id),
    g AS (SELECT cite, list(id ORDER BY id) AS ids FROM h WHERE rn = 1 GROUP BY cite)
    SELECT cite, CASE WHEN r IS NOT NULL THEN 'reporter_cite' WHEN q IS NOT NULL THEN 'parallel_cite' WHEN ids IS NOT NULL THEN 'docket' END AS matched_by,
        array_to_string(CASE WHEN coalesce(r, q) IS NOT NULL THEN [coalesce(r, q)] ELSE ids END, ',') AS opinion_ids FROM m LEFT JOIN g USING (cite)""", "opinion", "court")  # fmt: skip
def cite_lookup(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    other = op.select(F.col("id").alias("opinion_id"), F.concat(F.lit("9 Parallel "), F.col("id") % 5000).alias("cite"))
    asked = op.select(F.upper("reporter_cite").alias("cite")).union(other.select(F.lower("cite"))).union(op.select("case_number")).union(op.select(F.concat(F.lit("nothing"), "id")))
    return K.cites_to_opinions(asked, op, other, courts).withColumn("opinion_ids", F.array_join("opinion_ids", ","))


@query("""WITH j AS (SELECT judge.id, state_code, full_name, trim(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM judge JOIN court c ON c.id = court_id),
    a AS (SELECT slug AS name, state_code FROM j UNION SELECT lower(substr(full_name, 7, 18)), state_code FROM j UNION SELECT substr(full_name, 7, 16), state_code FROM j),
    e AS (SELECT name, a.state_code, min(id) AS by_slug FROM a JOIN j ON j.state_code = a.state_code AND slug = name GROUP BY ALL), l AS (SELECT name, a.state_code, list(id ORDER BY id) AS ids FROM a JOIN j ON j.state_code = a.state_code AND contains(lower(full_name), lower(name)) GROUP BY ALL)
    SELECT name, state_code, CASE WHEN by_slug IS NOT NULL THEN by_slug WHEN len(ids) = 1 THEN ids[1] END AS judge_id, CASE WHEN by_slug IS NULL AND len(ids) > 1 THEN array_to_string(ids[1:6], ',') ELSE '' END AS candidates
    FROM a LEFT JOIN e USING (name, state_code) LEFT JOIN l USING (name, state_code)""", "judge", "court")  # fmt: skip
def judge_lookup(spark, d):
    judges, courts = tables(spark, d, "judge", "court")
    j = judges.join(courts.select(F.col("id").alias("court_id"), "state_code"), "court_id").select("id", "state_code", "full_name", S.slugify(F.col("full_name")).alias("slug"))
    asked = j.select(F.col("slug").alias("name"), "state_code").union(j.select(F.lower(F.substring("full_name", 7, 18)), "state_code")).union(j.select(F.substring("full_name", 7, 16), "state_code"))
    return K.judges_by_name(asked, j).withColumn("candidates", F.array_join("candidates", ","))


@query("""WITH e AS (SELECT citing_id, citing_id % 40 AS cited_id, source AS treatment, context FROM edge), r AS (SELECT e.*, release_date, row_number() OVER (PARTITION BY cited_id ORDER BY release_date DESC, citing_id, treatment, context) AS pos FROM e JOIN opinion o ON o.id = citing_id)
    SELECT cited_id, CAST(pos AS INTEGER) AS pos, citing_id, release_date, treatment, substr(context, 1, 12) AS quote FROM r WHERE pos <= 15""", "edge", "opinion")  # fmt: skip
def citing_passages(spark, d):
    edges, op = tables(spark, d, "edge", "opinion")
    own = edges.select("citing_id", (F.col("citing_id") % 40).alias("cited_id"), F.col("source").alias("treatment"), "context")
    return K.citing_list(own, op, 15, 12)


LIST_SQL = """e AS (SELECT DISTINCT {key}, t.opinion_id, release_date FROM t JOIN opinion o ON o.id = t.opinion_id), c AS (SELECT {key}, least(count(*), {most}) AS opinions FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY release_date DESC, opinion_id) AS pos FROM e)
    SELECT {key}, opinions, CAST(pos AS INTEGER) AS pos, opinion_id, release_date FROM r JOIN c USING ({key}) WHERE pos <= {n}"""


@query("WITH t AS (SELECT CAST(l_partkey % 500 AS VARCHAR) AS statute, l_orderkey AS opinion_id FROM lineitem), " + LIST_SQL.format(key="statute", n=15, most=50_000), "opinion")
def statute_opinions(spark, d):
    li, op = tables(spark, d, "lineitem", "opinion")
    return K.opinions_of(li.select((F.col("l_partkey") % 500).cast("string").alias("statute"), F.col("l_orderkey").alias("opinion_id")), "statute", op, 15)


@query(f"WITH t AS ({TAG_SQL}), " + LIST_SQL.format(key="tag", n=50, most=50_000), "opinion")
def tag_opinions(spark, d):
    li, part, op = tables(spark, d, "lineitem", "part", "opinion")
    return K.opinions_of(li.join(part, li.l_partkey == part.p_partkey).select(F.col("p_brand").alias("tag"), F.col("l_orderkey").alias("opinion_id")), "tag", op, 50)


@query(f"""WITH {VEC_SQL}, s AS (SELECT v.vec_id, round(1 - {COS_SQL.format(a='v.e', b='q.e')}, 6) AS distance FROM v, (SELECT e FROM v WHERE vec_id = 7) q ORDER BY distance, vec_id LIMIT 10)
    SELECT vec_id, distance FROM s WHERE vec_id NOT IN (SELECT vec_id FROM v ORDER BY label, vec_id LIMIT 50)""")  # fmt: skip
def semantic_complement(spark, d):
    emb = role(spark, d, "embeddings")
    page = emb.orderBy("label", "vec_id").limit(50)
    return K.complement(page, Q.nearest(emb, emb.where("vec_id = 7").first().embedding, 100, key="vec_id"), 10, "vec_id")


@query("SELECT CAST(pos AS INTEGER) AS pos, id, title FROM (SELECT unnest([9, 3, 77, 12, 1000000007, 5]) AS id, unnest([1, 2, 3, 4, 5, 6]) AS pos) JOIN opinion USING (id)", "opinion")
def rank_preserving_order(spark, d):
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (9, 3, 77, 12, 1_000_000_007, 5)))).alias("at", "id")).select("id", (F.col("at") + 1).alias("pos"))
    return K.in_rank_order(ids, role(spark, d, "opinion")).select("pos", "id", "title")


@query("""WITH c AS (SELECT DISTINCT citing_id AS id FROM edge WHERE contains(context, 'overrule')), o AS (SELECT opinion.id, title, release_date FROM opinion JOIN c USING (id)) SELECT id, title, release_date, (SELECT count(*) FROM o) AS total FROM o ORDER BY release_date DESC, id LIMIT 25 OFFSET 25""", "edge", "opinion")
def paged_with_total(spark, d):
    edges, op = tables(spark, d, "edge", "opinion")
    ids = edges.where("contains(context, 'overrule')").select(F.col("citing_id").alias("id")).distinct()
    return K.page_with_total(op.join(ids, "id", "left_semi").select("id", "title", "release_date"), [F.desc("release_date"), F.col("id")], 2, 25)


# --- review ------------------------------------------------------------------------------------------------------------------------

OLD_SQL = "CAST(release_date - INTERVAL {y} YEAR AS DATE)"


@query(f"""WITH d AS (SELECT CASE id % 4 WHEN 0 THEN {OLD_SQL.format(y=160)} WHEN 1 THEN {OLD_SQL.format(y=105)} WHEN 2 THEN CAST(release_date + INTERVAL 7 YEAR AS DATE) ELSE release_date END AS day FROM opinion)
    SELECT CASE WHEN day < DATE '1849-01-01' THEN 'pre_1849' WHEN day < DATE '1900-01-01' THEN 'pre_1900' WHEN day > DATE '{REF_DATE}' THEN 'future' END AS sanity, count(*) AS n, count(*) FILTER (day < DATE '1849-01-01') AS flagged FROM d GROUP BY ALL""", "opinion")  # fmt: skip
def date_sanity_counts(spark, d):
    op = role(spark, d, "opinion")
    day = F.when(F.col("id") % 4 == 0, F.add_months("release_date", -160 * 12)).when(F.col("id") % 4 == 1, F.add_months("release_date", -105 * 12)).when(F.col("id") % 4 == 2, F.add_months("release_date", 84)).otherwise(F.col("release_date"))
    rows = V.flag_misdated(op.select(day.alias("release_date"), F.lit("draft").alias("review_status")))
    return rows.groupBy(V.date_sanity(F.col("release_date"), F.lit(REF_DATE).cast("date")).alias("sanity")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("review_status") == "flagged").cast("long")).alias("flagged"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'none' ELSE 'yes' END AS body FROM documents WHERE doc_id % 5 = 0 OR (text IS NOT NULL AND text <> '')")
def body_filter(spark, d):
    rows = role(spark, d, "documents").withColumn("raw_text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    none = V.with_body(rows, False).where("doc_id % 5 = 0").select("doc_id", F.lit("none").alias("body"))
    return none.union(V.with_body(rows).select("doc_id", F.lit("yes").alias("body")))


SUGGEST_SQL = "u AS (SELECT l_orderkey AS opinion_id, p_brand AS tag, min(p_type) AS category, max(l_discount) AS confidence, CASE WHEN min(l_linenumber) % 3 = 0 THEN 'rejected' WHEN min(l_linenumber) % 3 = 1 THEN 'pending' ELSE 'applied' END AS status FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"
SLICE_SQL = "s AS (SELECT u.* FROM u JOIN opinion o ON o.id = opinion_id JOIN court c ON c.id = court_id WHERE state_code = 'MN' AND confidence >= 0.05)"


def suggestions(spark, d):
    li, part = tables(spark, d, "lineitem", "part")
    n = F.min("l_linenumber") % 3
    return li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("opinion_id"), F.col("p_brand").alias("tag")).agg(
        F.min("p_type").alias("category"), F.max("l_discount").alias("confidence"), F.when(n == 0, "rejected").when(n == 1, "pending").otherwise("applied").alias("status"))


@query(f"WITH {SUGGEST_SQL}, {SLICE_SQL} SELECT status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM s GROUP BY ALL", "opinion", "court")
def suggestion_slice_totals(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    return V.slice_totals(V.suggestion_slice(suggestions(spark, d), op, courts, state=" mn ", min_confidence="0.05"))


@query(f"WITH {SUGGEST_SQL}, {SLICE_SQL} SELECT u.opinion_id, u.tag, CASE WHEN u.status = 'pending' AND s.tag IS NOT NULL THEN 'applied' ELSE u.status END AS status FROM u LEFT JOIN s ON s.opinion_id = u.opinion_id AND s.tag = u.tag", "opinion", "court")
def bulk_accept(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    rows = suggestions(spark, d)
    return V.accept(rows, V.suggestion_slice(rows, op, courts, state="MN", min_confidence="0.05")).select("opinion_id", "tag", "status")


# --- vectors on file ---------------------------------------------------------------------------------------------------------------

VECTOR_ROWS = "SELECT vec_id AS id, label AS court_id, CAST(DATE '1995-01-01' + CAST(vec_id * 10 AS INTEGER) AS DATE) AS release_date FROM embeddings"


def vector_rows(spark, d):
    return role(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("court_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("vec_id") * 10).cast("int")).alias("release_date"), "embedding")


@query(f"WITH o AS ({VECTOR_ROWS}) SELECT id AS opinion_id, court_id + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS court_id FROM o WHERE id % 7 = 0 OR id % 5 = 0")
def stale_vector_rows(spark, d):
    """What is stored names another court for one row in 7, and one opinion in 5 has no vector any more."""
    own = vector_rows(spark, d)
    stored = own.select(F.col("id").alias("opinion_id"), (F.col("court_id") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("court_id"), "release_date")
    return Q.stale_vectors(stored, own.withColumn("embedding", F.when(F.col("id") % 5 != 0, F.col("embedding")))).select("opinion_id", "court_id")


@query(f"WITH o AS ({VECTOR_ROWS}) SELECT court_id, CAST(min(year(release_date)) AS INTEGER) AS first_year, CAST(max(year(release_date)) AS INTEGER) AS last_year, count(*) AS n FROM o GROUP BY ALL")
def vector_year_bounds(spark, d):
    return Q.year_bounds(vector_rows(spark, d))


# --- small functions over whole tables -----------------------------------------------------------------------------------------------

@query(f"SELECT id, lower(level) AS level_slug, coalesce(nullif(CASE WHEN opinion.id % 2 = 0 THEN 'stored' ELSE '' END, ''), {outcome_sql()}) AS class FROM opinion JOIN (SELECT id AS court_id, level FROM court) USING (court_id)", "opinion", "court")
def slugs_and_classes(spark, d):
    op, courts = tables(spark, d, "opinion", "court")
    rows = op.join(courts.select(F.col("id").alias("court_id"), "level"), "court_id")
    stored = F.when(F.col("id") % 2 == 0, "stored").otherwise("")
    return rows.select("id", S.level_slug(F.col("level")).alias("level_slug"), S.disposition_class(stored, F.col("disposition")).alias("class"))


@query("WITH n AS (SELECT judge_id, count(*) AS n, count(*) FILTER (vote_type = 'MAJORITY_JOIN') AS joins FROM vote GROUP BY ALL) SELECT judge_id, CAST(round(CAST(joins AS DOUBLE) / n * 100) AS INTEGER) AS width FROM n", "vote")
def bar_widths(spark, d):
    by = role(spark, d, "vote").groupBy("judge_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vote_type") == "MAJORITY_JOIN", 1)).alias("joins"))
    return by.select("judge_id", S.bar_width(F.col("joins"), F.col("n")).alias("width"))


AGENTS = ("AhrefsBot/7", "Mozilla/5.0 (compatible; Applebot/0.1)", "meta-externalagent/1.1", "Mozilla/5.0 (X11)", "Magpie-Crawler/1")


@query(f"WITH a AS (SELECT [{', '.join(repr(a) for a in AGENTS)}][1 + event_id % 5] AS agent FROM events) SELECT CASE WHEN regexp_matches(lower(agent), '{'|'.join(L.BLOCKED_CRAWLERS)}') THEN 'blocked' WHEN regexp_matches(lower(agent), '{'|'.join(L.INDEXERS)}') THEN 'indexer' ELSE 'visitor' END AS kind, count(*) AS n FROM a GROUP BY ALL")
def crawler_kinds(spark, d):
    agent = F.get(F.array(*map(F.lit, AGENTS)), (F.col("event_id") % 5).cast("int"))
    return role(spark, d, "events").groupBy(L.crawler_kind(agent).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


PAREN_TEXTS = ("'(see Smith, J.)'", "'(1993) Smith, J.'", "'none Smith'", "'((a) Smith'", "'(' || repeat('x', 160) || 'Smith'")


@query(f"WITH t AS (SELECT id, CASE id % 5 {' '.join(f'WHEN {k} THEN {t}' for k, t in enumerate(PAREN_TEXTS))} END AS t FROM opinion), b AS (SELECT id, right(substr(t, 1, instr(t, 'Smith') - 1), 150) AS b FROM t) SELECT id, regexp_matches(b, '\\([^()]*$') AS inside FROM b", "opinion")
def parenthesis_guard(spark, d):
    t = F.expr(f"CASE id % 5 {' '.join(f'WHEN {k} THEN {t}' for k, t in enumerate(PAREN_TEXTS))} END")
    return role(spark, d, "opinion").select("id", S.inside_parenthesis(t, F.instr(t, "Smith") - 1).alias("inside"))


NAMES = ("Jennifer L. Frisch", "Frisch, Judge", "L. Frisch, J.", "Van Buren, Judge", "BOLICK, Vice Chief Justice", "")
LASTS = ("Frisch", "Frisch", "Frisch", "Buren", "BOLICK", "")


@query(f"SELECT id, [{', '.join(map(repr, LASTS))}][1 + id % 6] AS surname FROM opinion", "opinion")
def byline_surnames(spark, d):
    return role(spark, d, "opinion").select("id", S.byline_surname(F.get(F.array(*map(F.lit, NAMES)), (F.col("id") % 6).cast("int"))).alias("surname"))


@query("SELECT doc_id, list_aggregate(list_transform(string_split(text, ' '), lambda w: CASE WHEN w = upper(w) AND length(w) > 1 THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE w END), 'string_agg', ' ') AS text FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g')) AS text FROM documents)")
def title_casing(spark, d):
    """ASCII alone: the two engines differ in the capitals of some other letters."""
    return role(spark, d, "documents").select("doc_id", S.title_case(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", ""))).alias("text"))


# --- headers of opinions -------------------------------------------------------------------------------------------------------------

DAY = "CAST(1 + id % 28 AS STRING)"
FATE = "CASE id % 3 WHEN 0 THEN 'Affirmed' WHEN 1 THEN 'Reversed' ELSE 'Dismissed' END"
WRITER = "CASE id % 4 WHEN 0 THEN 'SMITH' WHEN 1 THEN 'LARKIN' WHEN 2 THEN 'O''BRIEN' ELSE 'BJORKMAN' END"
FOUR = "lpad(CAST(1 + id % 9000 AS STRING), 4, '0')"
HEADERS = {
    "MN": f"concat('STATE OF MINNESOTA\\nIN COURT OF APPEALS\\nA21-', {FOUR}, '\\n\\nState of Minnesota v. Doe\\n\\nFiled March ', {DAY}, ', 2022\\n', {FATE}, '\\n', initcap({WRITER}), ', Judge\\n\\nConsidered and decided by Jones, Presiding Judge; and Lee, Judge.\\n\\n', {WRITER}, ', Judge\\n\\nThe facts are these.')",
    "NH": f"concat('Case No. 2024-', {FOUR}, '\\nCitation: State v. Doe, 2026 N.H. ', CAST(1 + id % 99 AS STRING), '\\nOpinion Issued: March ', {DAY}, ', 2022\\n\\n', {WRITER}, ', J. The defendant appeals.\\n\\n', {FATE}, '.\\n\\nMACDONALD, C.J., and GOULD, JJ., concurred.')",
    "AZ": f"concat('No. CR-21-', {FOUR}, '\\nFiled March ', {DAY}, ', 2022\\n\\nJustice ', {WRITER}, ' authored the opinion of the Court, in which Justices Lopez and King joined.\\n\\n', upper({FATE}), '\\n\\nCOUNSEL\\n\\nThe facts are these.')",
    "LA": f"concat('STATE OF LOUISIANA\\nCOURT OF APPEAL, SECOND CIRCUIT\\nNo. 2020-CA-', {FOUR}, '\\nMarch ', {DAY}, ', 2022\\n\\nState of Louisiana v. Doe\\n\\n', {WRITER}, ', J.\\n\\nThe facts are these.\\n\\n', upper({FATE}), '.\\n')",
}
NUMBERS = {"MN": f"'A21-' || {FOUR}", "NH": f"'2024-' || {FOUR}", "AZ": f"'CR-21-' || {FOUR}", "LA": f"'2020-CA-' || {FOUR}"}
WRITER_NAME = "CASE id % 4 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Larkin' WHEN 2 THEN 'O''brien' ELSE 'Bjorkman' END"


@query(f"SELECT id, {by_state(NUMBERS)} AS case_number, make_date(2022, 3, CAST(1 + id % 28 AS INTEGER)) AS release_date, {FATE} AS disposition, {WRITER_NAME} AS author FROM opinion", "opinion")
def parse_headers(spark, d):
    """Headers of four states with the docket, date, outcome and writer of each row."""
    states = by_state({s: f"'{s}'" for s in HEADERS})
    docs = role(spark, d, "opinion").select("id", F.expr(states).alias("state_code"), F.expr(by_state(HEADERS)).alias("raw_text"))
    return T.parse_opinions(docs).select("id", "case_number", "release_date", "disposition", "author")


@query("SELECT id, cite, row_number() OVER (PARTITION BY id ORDER BY k) AS pos FROM (SELECT id, unnest([CAST(1 + id % 300 AS VARCHAR) || ' Minn. ' || CAST(1 + id % 999 AS VARCHAR), 'A' || CAST(10 + id % 89 AS VARCHAR) || '-0' || CAST(100 + id % 800 AS VARCHAR)]) AS cite, unnest([1, 2]) AS k FROM opinion)", "opinion")
def docket_form_cites(spark, d):
    text = F.concat(F.lit("See Doe v. Roe, "), F.col("id") % 300 + 1, F.lit(" Minn. "), F.col("id") % 999 + 1, F.lit(". State v. Poe, No. A"), F.col("id") % 89 + 10, F.lit("-"), F.col("id") % 800 + 100, F.lit(" (Minn. App. 2021), and A20-123 alone."))
    found = T.extract_cites(role(spark, d, "opinion").select("id", F.lit("MN").alias("state_code"), text.alias("raw_text"), F.lit("").alias("self_cite")))
    order = F.row_number().over(Window.partitionBy("id").orderBy("text_offset"))
    return found.select("id", F.col("reporter_cite").alias("cite"), order.alias("pos"))


LA_FORMS = (
    ("'La. C.C. art. ' || n", "'la.civ.' || n"), ("'La. Code Civ. Proc. art. ' || n || '(B)'", "'la.ccp.' || n || '.b'"), ("'La. Code Crim. Proc. art. ' || n", "'la.crimproc.' || n"), ("'La. Code Evid. art. ' || n", "'la.evid.' || n"),
    ("'La. Ch. C. art. ' || n", "'la.chc.' || n"), ("'La. Const. art. V, § ' || n", "'la.const.art-v.' || n"), ("'La. R.S. 13:' || n || '(A)'", "'la.rs.13-' || n || '.a'"),
)


@query(f"WITH o AS (SELECT id, CAST(1 + id % 900 AS VARCHAR) AS n FROM opinion) SELECT id, CASE id % 7 {' '.join(f'WHEN {k} THEN {s}' for k, (_, s) in enumerate(LA_FORMS))} END AS reference_slug, 4 AS text_offset FROM o", "opinion")
def statute_mentions_la(spark, d):
    """All seven families of Louisiana."""
    text = F.expr(f"'See ' || CASE id % 7 {' '.join(f'WHEN {k} THEN {t}' for k, (t, _) in enumerate(LA_FORMS))} END || '.'")
    docs = role(spark, d, "opinion").select("id", F.lit("LA").alias("state_code"), F.expr("CAST(1 + id % 900 AS STRING) AS n")).withColumn("raw_text", text)
    return T.extract_statutes(docs).select("id", "reference_slug", "text_offset")


@query("SELECT id, 'MAJORITY' AS kind, CASE WHEN id % 2 = 0 THEN 'CITED' ELSE 'OVERRULED' END AS treatment FROM opinion", "opinion")
def treatment_words(spark, d):
    context = F.when(F.col("id") % 2 == 0, "the court cited it").otherwise("we hereby overrule it, as explained in it")
    return role(spark, d, "opinion").select("id", F.lit("MAJORITY").alias("kind"), G.treatment(context).alias("treatment"))


# --- loading -----------------------------------------------------------------------------------------------------------------------

@query(r"""WITH e AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'p' || id END AS external_id, CASE WHEN id % 3 = 0 THEN 'known-' || id WHEN id < 60 THEN 'judge-n' || id ELSE 'judge-n' || (id % 60) || '-' || (id // 60 + 1) END AS slug, court_id, appointment_date FROM judge WHERE id % 3 <> 2),
    p AS (SELECT 'p' || id AS external_id, 'Judge N' || (id % 60) AS full_name, 'judge-n' || (id % 60) AS base, CASE WHEN id % 5 <> 0 THEN court_id END AS court, DATE '2001-02-03' AS appointed FROM judge),
    m AS (SELECT p.*, e.id AS by_id FROM p LEFT JOIN e USING (external_id)),
    r AS (SELECT m.*, e.id AS by_slug, row_number() OVER (PARTITION BY base, by_id IS NULL ORDER BY m.external_id) AS t FROM m LEFT JOIN e ON e.slug = base AND e.id NOT IN (SELECT by_id FROM m WHERE by_id IS NOT NULL)),
    k AS (SELECT *, coalesce(by_id, CASE WHEN t = 1 THEN by_slug END) AS id FROM r),
    n AS (SELECT base, list(n) AS taken FROM (SELECT slug AS base, CAST(1 AS BIGINT) AS n FROM e UNION SELECT regexp_replace(slug, '-\d+$', ''), CAST(regexp_extract(slug, '-([1-9]\d*)$', 1) AS BIGINT) FROM e WHERE regexp_matches(slug, '-[1-9]\d*$')) GROUP BY base),
    c AS (SELECT k.*, row_number() OVER (PARTITION BY base ORDER BY external_id) AS turn, coalesce(taken, []) AS taken FROM k LEFT JOIN n USING (base) WHERE k.id IS NULL),
    f AS (SELECT *, [x FOR x IN range(1, turn + len(taken) + 1) IF NOT list_contains(taken, x)][turn] AS n FROM c)
    SELECT CAST(NULL AS BIGINT) AS id, external_id, full_name, court AS court_id, appointed AS appointment_date, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug, 'created' AS action FROM f
    UNION ALL SELECT e.id, k.external_id, full_name, coalesce(court, e.court_id), coalesce(e.appointment_date, appointed), e.slug, 'updated' FROM k JOIN e ON e.id = k.id""", "judge")  # fmt: skip
def judge_sync(spark, d):
    """All judges loaded again under 60 names: a third is on file by external id, a third by slugs of which many are taken, a third is new."""
    j = role(spark, d, "judge").select("id", "court_id", "appointment_date")
    i, name = F.col("id"), F.col("id") % 60
    slug = F.when(i % 3 == 0, F.concat(F.lit("known-"), i)).when(i < 60, F.concat(F.lit("judge-n"), i)).otherwise(F.concat(F.lit("judge-n"), name, F.lit("-"), F.floor(i / 60) + 1))
    external = F.concat(F.lit("p"), i)
    existing = j.where(i % 3 != 2).select("id", F.when(i % 3 == 0, external).alias("external_id"), slug.alias("slug"), "court_id", "appointment_date")
    loaded = j.select(external.alias("external_id"), F.concat(F.lit("Judge N"), name).alias("full_name"), F.when(i % 5 != 0, F.col("court_id")).alias("court_id"), F.lit("2001-02-03").cast("date").alias("appointment_date"))
    return I.sync_judges(loaded, existing)
