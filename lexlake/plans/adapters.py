"""Role tables over the test tables.

Each role is one portable SQL query, read by Spark here and put before the checking SQL as a common table expression
there, so that both sides start from the same rows. The operators themselves are written twice, as DataFrames and as
SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexlake.operators.stored import tasks_of

REF_DATE = "2001-09-01"

#: name -> (tables and roles it reads, SQL)
ROLES: dict[str, tuple[tuple[str, ...], str]] = {
    "court": (("nation", "region"), """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CASE r_regionkey WHEN 0 THEN 'MN' WHEN 1 THEN 'NH' WHEN 2 THEN 'AZ' WHEN 3 THEN 'LA' ELSE 'TX' END AS state_code,
               CASE WHEN n_nationkey % 3 = 0 THEN 'SUPREME' ELSE 'APPEALS' END AS level, CASE WHEN n_nationkey % 3 = 2 THEN '1' ELSE '' END AS division, n_name AS name
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "judge": (("supplier",), """
        SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS court_id,
               'Judge ' || s_name || CASE WHEN s_suppkey % 7 = 0 THEN ' Jr.' WHEN s_suppkey % 11 = 0 THEN ' III' ELSE '' END AS full_name,
               s_acctbal > 3000 AS is_currently_seated, CASE WHEN s_suppkey % 4 = 0 THEN 'bio' ELSE '' END AS bio_summary,
               CASE WHEN s_suppkey % 3 = 0 THEN CAST('1994-05-01' AS DATE) END AS appointment_date
        FROM supplier"""),
    "opinion": (("orders", "customer"), """
        SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS court_id, CAST(o_orderdate AS DATE) AS release_date,
               CASE o_orderkey % 6 WHEN 0 THEN 'a21' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') WHEN 1 THEN 'No. A15-' || CAST(o_orderkey % 1000 AS STRING)
                    WHEN 2 THEN 'A16-' || CAST(o_orderkey % 100 AS STRING) WHEN 3 THEN 'cl-' || CAST(o_orderkey AS STRING) WHEN 4 THEN '1 CA-CV 09-' || CAST(o_orderkey % 900 AS STRING)
                    ELSE '2014-' || lpad(CAST(o_orderkey % 7000 AS STRING), 4, '0') END AS case_number,
               CASE WHEN o_orderkey % 10 = 9 THEN '' ELSE CAST(100 + o_orderkey % 800 AS STRING) || ' N.W.2d ' || CAST(1 + CAST(floor(o_orderkey / 800) AS BIGINT) AS STRING) END AS reporter_cite,
               'State v. ' || c_name AS title, o_orderpriority <> '5-LOW' AS is_precedential,
               CASE WHEN o_orderkey % 12 = 0 THEN '' WHEN o_orderkey % 12 = 1 THEN 'Affirmed in part, reversed in part' WHEN o_orderkey % 12 = 2 THEN 'Reversed and remanded' WHEN o_orderkey % 12 = 3 THEN 'Vacated and remanded'
                    WHEN o_orderkey % 12 = 4 THEN 'Remanded' WHEN o_orderkey % 12 = 5 THEN 'Modified' WHEN o_orderkey % 12 = 6 THEN 'Stayed' WHEN o_orderkey % 12 = 7 THEN 'Granted'
                    WHEN o_orderkey % 12 = 8 THEN 'Denied' WHEN o_orderkey % 12 = 9 THEN 'Exceptions overruled' ELSE 'Affirmed' END AS disposition
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "vote": (("lineitem",), """
        SELECT opinion_id, judge_id, CASE code % 10 WHEN 0 THEN 'MAJORITY_JOIN' WHEN 1 THEN 'MAJORITY_AUTHOR' WHEN 2 THEN 'DISSENT_JOIN' WHEN 3 THEN 'CONCURRENCE_JOIN' WHEN 4 THEN 'CONCURRENCE_AUTHOR'
                    WHEN 5 THEN 'DISSENT_AUTHOR' WHEN 6 THEN 'RECUSED' ELSE 'NOT_PARTICIPATING' END AS vote_type
        FROM (SELECT l_orderkey AS opinion_id, l_suppkey AS judge_id, min(l_linenumber * 10
                     + (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END + 3 * (l_linenumber % 2)) % 8) AS code
              FROM lineitem GROUP BY l_orderkey, l_suppkey) v"""),
    "edge": (("lineitem",), """
        SELECT DISTINCT l_orderkey AS citing_id, CAST(100 + (l_partkey * 37 + l_suppkey * 11) % 800 AS STRING) || ' N.W.2d ' || CAST(1 + (l_partkey * 13 + l_suppkey) % 25 AS STRING) AS cite,
               CASE WHEN l_linenumber % 2 = 0 THEN 'bulk' ELSE 'extracted' END AS source,
               CASE (l_partkey + l_suppkey) % 7 WHEN 0 THEN 'we hereby overrule that case' WHEN 1 THEN 'the facts are distinguishable here' WHEN 2 THEN 'courts have declined to follow it' WHEN 3 THEN 'we follow that rule'
                    WHEN 4 THEN 'as explained in that case' ELSE 'cited in passing' END AS context
        FROM lineitem"""),
    "log": (("events",), """
        SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CASE event_id % 40 WHEN 3 THEN 502 WHEN 7 THEN 404 ELSE 200 END AS status,
               CASE event_id % 5 WHEN 0 THEN '/opinion/a21' || lpad(CAST(event_id % 3000 * 6 % 10000 AS STRING), 4, '0') || '/' WHEN 1 THEN '/judge/j' || CAST(user_id AS STRING) || '/' WHEN 2 THEN '/statute/s' || CAST(user_id % 9 AS STRING) || '/'
                    WHEN 3 THEN '/opinion/x' || CAST(user_id AS STRING) || '/cited-by/' ELSE '/sitemap-' || CAST(event_id % 4 AS STRING) || '.xml' END AS path,
               CASE user_id % 4 WHEN 0 THEN 'Mozilla/5.0 ChatGPT-User/1.0' WHEN 1 THEN 'GPTBot/1.1' WHEN 2 THEN 'Claude-User/2' ELSE 'Mozilla/5.0 (X11)' END AS agent
        FROM events"""),
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The roles behind ``names``, in the order in which they must be defined."""
    out: list[str] = []
    for n in names:
        if n in ROLES:
            out += [x for x in needed(ROLES[n][0]) if x not in out]
            out += [n] if n not in out else []
    return out


def role(spark: SparkSession, sf_dir: str, name: str, by: dict[str, str] | None = None) -> DataFrame:
    """A role, or a test table, as a DataFrame. ``by``: columns by which test tables are dealt before anything else."""
    if name not in ROLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return table.repartition(tasks_of(table), by[name]) if by and name in by else table
    reads, sql = ROLES[name]
    inputs = {r: role(spark, sf_dir, r, by) for r in reads}
    for r in reads:
        sql = sql.replace(f"FROM {r}", f"FROM {{{r}}}").replace(f"JOIN {r}", f"JOIN {{{r}}}")
    return spark.sql(sql, **inputs)


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the roles that it reads before it."""
    ctes = [f"{n} AS ({ROLES[n][1]})" for n in needed(names)]
    head = ", ".join(ctes)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
