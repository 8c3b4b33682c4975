"""Registered queries of merges: closure, fields, votes, derived rows and citations. Imported by ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.functions import scalars as S
from lexlake.operators import merging as M
from lexlake.plans.adapters import ROLES, role
from lexlake.plans.registry import CANON_SQL, RANK_SQL, query, tables

FIELDS = ", ".join(f"CASE WHEN (id + {k}) % 3 = 0 THEN '' ELSE 'f{k} ' || CAST(id AS STRING) END AS {f}" for k, f in enumerate(M.OPINION_FIELDS))

# Opinions of which a third each are spelled canonically, in small letters, or with "No.", on two dates, with captions that agree or do not.
ROLES["double"] = (("opinion",), f"""
    SELECT id, court_id, CASE id % 2 WHEN 0 THEN CAST('1999-01-04' AS DATE) ELSE CAST('2001-02-05' AS DATE) END AS release_date,
           CASE CAST(floor(id / 150) AS BIGINT) % 3 WHEN 0 THEN 'A21-' WHEN 1 THEN 'a21' ELSE 'No. A21-' END || lpad(CAST(id % 150 AS STRING), 4, '0') AS case_number,
           CASE id % 11 WHEN 10 THEN '' ELSE 'State v. ' || CASE id % 4 WHEN 0 THEN 'Ames' WHEN 1 THEN 'Boyd' WHEN 2 THEN 'Cole' ELSE 'Dunn' END || ' & ' || CASE id % 3 WHEN 0 THEN 'Orr' WHEN 1 THEN 'Pike' ELSE 'Ames' END END AS title,
           {FIELDS}
    FROM opinion""")  # fmt: skip
# Pairs that were looked at: each canonical row and the one before it in its court and on its date, with a break now and then (chains of many rows).
ROLES["reviewed"] = (("double",), """
    SELECT id AS loser, prior AS survivor FROM (SELECT id, lag(id) OVER (PARTITION BY court_id, release_date ORDER BY id) AS prior FROM double WHERE case_number LIKE 'A21-%') p WHERE prior IS NOT NULL AND id % 40 <> 7""")
ROLES["cites"] = (("lineitem",), """
    SELECT l_orderkey AS citing_id, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(1 + (l_partkey * 3 + l_suppkey) % 1500 AS BIGINT) END AS cited_id, CAST(l_suppkey % 40 AS STRING) || ' N.W.2d ' || CAST(l_linenumber AS STRING) AS cite,
           CASE WHEN l_partkey % 2 = 0 THEN 'bulk' ELSE 'extracted' END AS source
    FROM lineitem""")

NOISE = "[" + ", ".join(repr(w) for w in S.CAPTION_NOISE) + "]"


def tokens_sql(c: str) -> str:
    return f"[w FOR w IN list_distinct(string_split_regex(regexp_replace(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\bvs?\\b', ' ', 'g'), '\\s+')) IF w <> '' AND NOT list_contains({NOISE}, w)]"


PAIR_SQL = f"""(WITH RECURSIVE r AS (SELECT id, court_id, release_date, case_number, {tokens_sql('title')} AS t, {CANON_SQL} AS canon FROM double),
    d AS (SELECT a.id AS loser, b.id AS survivor, a.t AS x, b.t AS y FROM r a JOIN (SELECT court_id, release_date, case_number, arg_min(t, id) AS t, min(id) AS id FROM r GROUP BY ALL) b
          ON b.court_id = a.court_id AND b.release_date = a.release_date AND b.case_number = a.canon WHERE a.canon <> a.case_number),
    step AS (SELECT loser, survivor FROM d WHERE least(len(x), len(y)) = 0 OR len(list_intersect(x, y)) / least(len(x), len(y)) >= 0.5 UNION SELECT loser, survivor FROM reviewed),
    one AS (SELECT loser, min(survivor) AS survivor FROM step GROUP BY loser),
    walk AS (SELECT loser, survivor AS goal, 1 AS n FROM one UNION ALL SELECT walk.loser, one.survivor, n + 1 FROM walk JOIN one ON one.loser = walk.goal)
    SELECT loser, arg_max(goal, n) AS survivor FROM walk GROUP BY loser)"""


def plan(spark, d):
    double, reviewed = tables(spark, d, "double", "reviewed")
    return M.discovered_pairs(double).unionByName(M.reviewed_pairs(reviewed, double, trust_titles=True))


def merged(spark, d, **children):
    return M.merge_opinions(children, plan(spark, d))


@query(f"SELECT loser, survivor FROM {PAIR_SQL} m", "double", "reviewed")
def merge_closure(spark, d):
    return M.closure(plan(spark, d))


@query("WITH p AS MATERIALIZED " + PAIR_SQL + ", f AS (SELECT survivor, " + ", ".join(f"arg_min({f}, loser) FILTER ({f} <> '') AS n_{f}" for f in M.OPINION_FIELDS) + " FROM p JOIN double ON id = loser GROUP BY survivor) SELECT id, court_id, release_date, case_number, title, "
       + ", ".join(f"CASE WHEN {f} = '' THEN coalesce(n_{f}, '') ELSE {f} END AS {f}" for f in M.OPINION_FIELDS) + " FROM double LEFT JOIN f ON survivor = id WHERE id NOT IN (SELECT loser FROM p)", "double", "reviewed")
def merged_opinions(spark, d):
    return merged(spark, d, opinions=role(spark, d, "double"))["opinions"]


@query(f"""WITH p AS MATERIALIZED {PAIR_SQL}, v AS (SELECT coalesce(survivor, opinion_id) AS opinion_id, judge_id, vote_type, survivor IS NOT NULL AS moved, vote.opinion_id AS was FROM vote LEFT JOIN p ON loser = vote.opinion_id)
    SELECT opinion_id, judge_id, vote_type FROM v QUALIFY row_number() OVER (PARTITION BY opinion_id, judge_id ORDER BY moved, was, vote_type) = 1""", "double", "reviewed", "vote")
def merged_panel_votes(spark, d):
    return merged(spark, d, votes=role(spark, d, "vote"))["votes"]


@query(f"""WITH p AS MATERIALIZED {PAIR_SQL}, s AS (SELECT l_orderkey AS opinion_id, CAST(l_partkey % 50 AS VARCHAR) AS statute FROM lineitem WHERE l_orderkey % 3 <> 0),
    v AS (SELECT coalesce(survivor, opinion_id) AS opinion_id, statute, CASE WHEN survivor IS NULL THEN -1 ELSE s.opinion_id END AS was FROM s LEFT JOIN p ON loser = s.opinion_id)
    SELECT opinion_id, statute FROM v QUALIFY was = min(was) OVER (PARTITION BY opinion_id)""", "double", "reviewed")
def merged_statutes(spark, d):
    rows = role(spark, d, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("opinion_id"), (F.col("l_partkey") % 50).cast("string").alias("statute"))
    return merged(spark, d, statutes=rows)["statutes"]


@query(f"""WITH p AS MATERIALIZED {PAIR_SQL}, e AS (SELECT coalesce(a.survivor, citing_id) AS citing_id, coalesce(b.survivor, cited_id) AS cited_id, cite, source, a.survivor IS NOT NULL AS o, b.survivor IS NOT NULL AS i, citing_id AS a, cited_id AS b
        FROM cites LEFT JOIN p a ON a.loser = citing_id LEFT JOIN p b ON b.loser = cited_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY citing_id, cited_id, cite, source ORDER BY o OR i, a, b NULLS FIRST, cite, source) AS x, row_number() OVER (PARTITION BY citing_id, cited_id, source ORDER BY o OR i, a, b NULLS FIRST, cite, source) AS y
        FROM e WHERE cited_id IS NULL OR citing_id <> cited_id OR NOT (o OR i))
    SELECT citing_id, cited_id, cite, source FROM r WHERE NOT (o AND x > 1) AND NOT (i AND y > 1)""", "double", "reviewed", "cites")  # fmt: skip
def merged_citations(spark, d):
    return merged(spark, d, edges=role(spark, d, "cites"))["edges"]


ORDER_SQL = "SELECT s_suppkey AS loser, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey - 10 ELSE s_suppkey - s_suppkey % 10 END AS survivor FROM supplier WHERE s_suppkey > 10 AND s_suppkey % 50 <> 0"


@query(f"""WITH p AS MATERIALIZED (WITH RECURSIVE one AS ({ORDER_SQL}), walk AS (SELECT loser, survivor AS goal, 1 AS n FROM one UNION ALL SELECT walk.loser, one.survivor, n + 1 FROM walk JOIN one ON one.loser = walk.goal) SELECT loser, arg_max(goal, n) AS survivor FROM walk GROUP BY loser)
    SELECT opinion_id, coalesce(survivor, judge_id) AS judge_id, arg_max(vote_type, {RANK_SQL}) AS vote_type FROM vote LEFT JOIN p ON loser = judge_id GROUP BY ALL""", "vote", "judge")  # fmt: skip
def merged_judge_votes(spark, d):
    """Each ten judges are one, and each five tens as well: stars of chains."""
    votes, judges = tables(spark, d, "vote", "judge")
    return M.merge_judges(judges, votes, role(spark, d, "supplier").sparkSession.sql(ORDER_SQL.replace("FROM supplier", "FROM {s}"), s=role(spark, d, "supplier")))[1]
