"""Registered queries of the stored indexes: words and phrases by position, substrings by grams, vectors by bands of dates. Imported by ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlake.operators import bands as B
from lexlake.operators import grams as N
from lexlake.operators import search as Q
from lexlake.operators.postings import WordIndex
from lexlake.operators.stored import fresh_dir
from lexlake.plans.adapters import role
from lexlake.plans.registry import COS_SQL, PHRASES, TOKENS_SQL, VEC_SQL, query, tables

#: Separators as the index sees them.
GAP = "[^\\p{L}\\p{N}_]"
WORD_QUERIES = ("and ing", "in the of", "que del", "+court -ruled", "nothing like it anywhere", "der")
CAP = 40


def index_of_documents(spark, d) -> WordIndex:
    return WordIndex.write(role(spark, d, "documents"), fresh_dir(spark, "word-index"), key="doc_id")


PHRASE_SQL = f"""p AS (SELECT unnest({list(PHRASES)!r}) AS p), c AS (SELECT p AS tag, count(*) FILTER (regexp_matches(lower(text), '(^|{GAP})' || replace(p, ' ', '{GAP}+') || '($|{GAP})')) AS n FROM documents, p GROUP BY p)"""


@query(f"WITH {PHRASE_SQL} SELECT tag, n FROM c")
def index_phrase_counts(spark, d):
    return index_of_documents(spark, d).phrase_counts(list(PHRASES))


@query(f"""WITH {PHRASE_SQL}, s AS (SELECT min(n) AS lo, greatest(max(n) - min(n), 1) AS span FROM c WHERE n > 0)
    SELECT tag, n, ['xs', 'sm', 'md', 'lg', 'xl'][least(CAST(floor((n - lo) / span * 5) AS INTEGER), 4) + 1] AS size, CAST(row_number() OVER (ORDER BY n DESC, lower(tag)) AS INTEGER) AS pos FROM c, s WHERE n > 0""")  # fmt: skip
def index_tag_cloud(spark, d):
    return Q.tag_cloud(index_of_documents(spark, d).phrase_counts(list(PHRASES)))


TERMS_SQL = ", ".join(f"({q!r}, {sorted({w.lower() for w in Q.query_terms(q)})!r})" for q in WORD_QUERIES)


@query(f"""WITH q(query, terms) AS (VALUES {TERMS_SQL}), d AS MATERIALIZED (SELECT doc_id, {TOKENS_SQL} AS t FROM documents), h AS (SELECT query, doc_id AS key, row_number() OVER (PARTITION BY query ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY query) > {CAP} AS capped FROM q JOIN d ON len(terms) > 0 AND list_has_all(t, terms))
    SELECT query, key, capped FROM h WHERE n <= {CAP}""")  # fmt: skip
def index_word_search(spark, d):
    """Queries of several words; one has no word that counts, and so no text."""
    return index_of_documents(spark, d).texts_with_all(list(WORD_QUERIES), CAP)


FRAGMENTS = ("right(name, 4)", "substr(name, 2, 7)", "right(name, 2)", "substr(name, 10)")


@query(f"""WITH n AS (SELECT full_name AS name FROM judge UNION SELECT c_name FROM customer), q AS ({" UNION ".join(f"SELECT lower({f}) AS q FROM n" for f in FRAGMENTS)}), t AS (SELECT lower(title) AS t, count(*) AS n FROM (SELECT title FROM opinion UNION ALL SELECT full_name FROM judge) GROUP BY ALL)
    SELECT q AS request, CAST(sum(n) AS BIGINT) AS n, min(t) AS first FROM q JOIN t ON contains(t, q) GROUP BY q""", "judge", "opinion")  # fmt: skip
def substring_requests(spark, d):
    """Parts of all names, each looked for in all titles and names."""
    judges, op, people = tables(spark, d, "judge", "opinion", "customer")
    names = judges.select(F.col("full_name").alias("name")).union(people.select("c_name")).distinct()
    texts = op.select(F.col("title").alias("t")).union(judges.select("full_name"))
    found = N.containing(names.select(F.explode(F.array(*[F.expr(f) for f in FRAGMENTS])).alias("q")), texts)
    counts = texts.groupBy(F.lower("t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(counts, "t").groupBy(F.col("q").alias("request")).agg(F.sum("n").alias("n"), F.min("t").alias("first"))


BAND_SQL = f"WITH {VEC_SQL}, x AS MATERIALIZED (SELECT vec_id, e, label % 3 AS grp, CASE WHEN vec_id % 41 <> 5 THEN DATE '1992-01-01' + CAST(vec_id * 37 % 9000 AS INTEGER) END AS d FROM v)"


@query(f"""{BAND_SQL}, p AS (SELECT a.vec_id AS source_id, b.vec_id AS id, round(1 - {COS_SQL.format(a='a.e', b='b.e')}, 6) AS distance FROM x a JOIN x b ON a.grp = b.grp AND a.vec_id <> b.vec_id AND (a.d IS NULL OR b.d BETWEEN a.d - 1095 AND a.d + 1095)),
    r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY distance, id) AS pos FROM p) SELECT source_id, CAST(pos AS INTEGER) AS pos, id, distance, CAST(least(100, greatest(0, round_even((1 - distance) * 100, 0))) AS INTEGER) AS similarity_pct FROM r WHERE pos <= 5""")  # fmt: skip
def similar_in_band(spark, d):
    """Every vector's five neighbours of its group within three years; a few have no date."""
    day = F.when(F.col("vec_id") % 41 != 5, F.date_add(F.lit("1992-01-01").cast("date"), (F.col("vec_id") * 37 % 9000).cast("int")))
    items = role(spark, d, "embeddings").withColumns({"release_date": day, "state": F.col("label") % 3})
    return B.similar_in_band(items, key="vec_id", group="state")
