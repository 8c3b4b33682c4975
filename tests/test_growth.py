"""Steps whose work may not grow faster than their tables: the rows that the operators of a plan put out are counted."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexlake.functions import legal_patterns as P
from lexlake.functions import legal_text as T
from lexlake.operators import graph as G
from lexlake.operators import grams as N
from lexlake.operators import merging as M
from lexlake.operators import postings as W
from lexlake.operators import resolve as R
from lexlake.operators import stored
from lexlake.plans import registry


def most_rows(df):
    """The rows of a table, and the most rows that one operator of its plan put out, by Spark's own count."""
    out, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        count = node.metrics().get("numOutputRows")
        most = max(most, count.get().value() if count.isDefined() else 0)
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return out, most


def test_requests_for_many_dates_of_a_docket_do_not_multiply(spark):
    day = lambda k: datetime.date(2000, 1, 1) + datetime.timedelta(days=k)
    ops = spark.createDataFrame([(k, 1 + k % 2, "A20-0001", day(k % 500)) for k in range(2_000)], "id long, court_id long, case_number string, release_date date")
    ask = spark.createDataFrame([(k, "A20-0001", ("", "appeals", " APPEALS ", "none")[k % 4], day(k)) for k in range(600)], "request_id long, docket string, want_level string, want_date date")
    courts = spark.createDataFrame([(1, "SUPREME"), (2, "APPEALS")], "id long, level string")
    found, most = most_rows(R.docket_lookup(ask, ops, courts))
    want = {}
    for k in range(600):
        # odd days are those of the appeals court; the newest day is the last odd one
        hit = k < 500 and (k % 4 == 0 or k % 4 in (1, 2) and k % 2 == 1)
        want[k] = k if hit else 1_999 if k % 4 in (1, 2) else 498
    assert {r.request_id: r.opinion_id for r in found} == want
    assert most <= 5_000


def test_only_rows_that_others_name_go_through_the_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(M, "store", lambda df, path, own=M.store: stored.append(own(df, path)) or stored[-1])
    monkeypatch.setattr(M, "discard", lambda *_: None)
    pairs = [(k, k - 1) for k in range(1, 3_000)] + [(k, 7) for k in range(3_000, 6_000)] + [(9_002, 9_000), (9_000, 9_001), (9_001, 9_002)]
    got = {(r.loser, r.survivor) for r in M.closure(spark.createDataFrame(pairs, "loser long, survivor long")).collect()}
    assert got == {(k, 0) for k in range(1, 6_000)} | {(9_001, 9_000), (9_002, 9_000)}
    assert sum(df.count() for df in stored) < 7_000


def test_equal_citations_of_merged_rows_meet_before_the_shuffle(spark):
    edges = spark.createDataFrame([(k, 5_000 + k % 2, "1 N.W.2d 1", "bulk") for k in range(1, 3_000)], "citing_id long, cited_id long, cite string, source string").coalesce(2)
    plan = spark.createDataFrame([(k, 1) for k in range(2, 3_000)], "loser long, survivor long")
    merged = M.moved_edges(edges, plan)
    text = merged._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in merged.collect())
    assert got == [(1, 5_000, "1 N.W.2d 1", "bulk"), (1, 5_001, "1 N.W.2d 1", "bulk")]
    # the windows read what an aggregate has left
    assert text.index("Window") < text.index("Aggregate") and "min(struct(#a" in text


def test_numbers_are_not_looked_for_under_three_digits(spark):
    texts = spark.createDataFrame([(f"Name#{k * 7_919 % 1_000_000:09d}",) for k in range(4_000)], "t string")
    queries = texts.selectExpr("substr(t, 6) AS q")
    found, most = most_rows(N.candidates(queries, texts))
    assert sorted(r.q for r in found) == sorted(r.t[5:] for r in found) and len(found) == 4_000
    assert most <= 4_000 * 10


def test_texts_are_dealt_to_more_tasks_as_they_grow(spark, sf, monkeypatch):
    monkeypatch.setattr(registry, "READ_AT_ONCE", 100, raising=False)
    n = registry.role(spark, sf, "orders").count()
    for name in ("parse_opinions", "bylines", "circuit_detect"):
        assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() >= n / 100 > 4


def test_a_head_is_read_for_all_parishes_at_once(monkeypatch):
    heads = ["", "No court named", "the parish is old", "Parish of Nowhere", "Parishes of Caddo"]
    heads += [form.format(name) for names in P.PARISH_CIRCUITS.values() for name in names.split(", ") for form in ("Parish  of {}.", "in {} parish", "PARISH OF {}x", "Parish of {} and Orleans Parish")]

    def plainly(head):
        found = {n for n, names in P.PARISH_CIRCUITS.items() for name in names.split(", ") if re.search(rf"(?i)\bparish\s+of\s+{re.escape(name)}\b|\b{re.escape(name)}\s+parish\b", head)}
        return found.pop() if len(found) == 1 else None

    want, searches = [plainly(h) for h in heads], []
    monkeypatch.setattr(T.re, "search", lambda *a, own=re.search: searches.append(1) or own(*a))
    assert [T.circuit(h) for h in heads] == want
    assert len(searches) <= 6 * len(heads)


def test_panels_are_read_in_time_that_grows_with_the_heading():
    began = time.monotonic()
    assert T.byline("COURT OF APPEAL " + "SUPERIOR " * 3 + "\n\nSMITH, J.\n\nThe facts.")["panel_last"] == []
    assert time.monotonic() - began < 1
    # names that no space parts were one name, so the pattern finds what it found when it let them part
    loose = P.PANELS["NH"].replace(r"(?:,\s*|\s+|(?<=\.)|(?=and\s))", r",?\s*")
    assert loose != P.PANELS["NH"]
    rng = random.Random(5)
    pieces = ["AB", "CDJ", "JJ", "J", ".", ",", " ", "\n", "and ", ", C.J.", " C. J.", "J., concurred", " JJ., concurred", "JJ., concurred", "-", "x"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(2, 7))) + rng.choice(["", ", JJ., concurred", "J., concurred"])
        a, b = re.search(loose, text), re.search(P.PANELS["NH"], text)
        assert (a and (a.span(), a[1])) == (b and (b.span(), b[1])), text


def test_places_of_a_block_are_gathered_before_the_shuffle(spark):
    docs = spark.createDataFrame([(k, "of the of court" if k % 2 else "the end") for k in range(1_000)] + [(5, "new the of"), (5, "the"), (None, "the"), (7, None), (-3, "the"), (1_500, "")], "id long, text string").coalesce(1)
    rows = W.postings(docs)
    found, most = most_rows(rows)
    lists = {(r.token, r.block): dict(zip(r["keys"], r.places)) for r in found}
    assert all(list(r["keys"]) == sorted(set(r["keys"])) and r.n == len(r["keys"]) for r in found)
    assert lists[("of", 0)] == {k: [0, 2] for k in range(1, 1_000, 2)} and lists[("court", 0)][9] == [3]
    assert lists[("the", 0)][5] == [0, 1] and lists[("the", -1)] == {-3: [0]} and lists[("new", 0)] == {5: [0]} and len(lists) == 6
    assert most <= 1_006


@pytest.mark.parametrize("name,key", [("concordance_matrix", "l_orderkey"), ("statute_detail_counts", "l_orderkey"), ("tag_index_filtered_count", "opinion_id")])
def test_lineitem_is_dealt_by_opinion_to_more_tasks_as_it_grows(spark, sf, monkeypatch, name, key):
    monkeypatch.setattr(stored, "ROWS_AT_ONCE", 500, raising=False)
    n = -(-registry.role(spark, sf, "lineitem").count() // 500)
    text = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", text)
    assert n > 10 and dealt and {(k, int(m)) for k, m in dealt} == {(key, n)}
    # rows of an opinion are where they are joined and grouped by it: no exchange of theirs, and no grouping before it
    below = text[text.index("REPARTITION_BY_NUM"):].split("Exchange")[0]
    assert "Aggregate" not in below and not re.search(r"hashpartitioning\(l_orderkey#\d+L?, l_suppkey", text)


def test_a_page_of_citing_opinions_resolves_citations_once(spark, sf, monkeypatch):
    asked, built = [], []
    monkeypatch.setattr(G, "store", lambda df, path, own=G.store: asked.append(df) or built.append(own(df, path)) or built[-1])
    page = registry.QUERIES["cited_by_page"](spark, sf)
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in (*asked, page)]
    assert [("lineitem.parquet" in t) for t in texts] == [True, True, False]
    assert "cited in passing" not in "".join(texts)  # what is said is not carried along
    edges = registry.edges(spark, sf).where("cited_id IS NOT NULL").select("citing_id", "cited_id")
    assert sorted(map(tuple, built[1].collect())) == sorted(map(tuple, edges.collect()))
    top = G.cited_by(edges).orderBy(F.desc("citing_count"), "cited_id").first()
    assert G.most_cited(built[1]) == top.cited_id and G.most_cited(built[1].limit(0)) is None


def test_each_spelling_of_a_docket_is_read_once(spark):
    ops = spark.createDataFrame([(k, "", ("a210001", "A21-0001", "A20-7", "No. ", None, "")[k % 6] if k < 60 else "No. A19-8", datetime.date(2000, 1, 1)) for k in range(61)], "id long, reporter_cite string, case_number string, release_date date")
    cites = G.cite_map(ops)
    assert [tuple(r) for r in cites.collect()] == [("A19-0008", 60)]
    text = cites._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "RLIKE" in text and "RLIKE" not in text[text.index("hashpartitioning(case_number"):]


def test_rows_of_a_view_are_counted_by_more_tasks_as_they_grow(spark, sf, monkeypatch):
    monkeypatch.setattr(stored, "ROWS_AT_ONCE", 500, raising=False)
    text = registry.QUERIES["incremental_tag_counts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+#\d+L?, \w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", text)
    assert len(dealt) == 1 and int(dealt[0][1]) > 4 and "Aggregate" not in text[text.index("REPARTITION_BY_NUM"):]
