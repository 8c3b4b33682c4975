"""Closure of merge plans, and what the merged tables look like."""

import random

import pytest

from lexlake.operators import merging as M


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def plan(spark, *pairs):
    return spark.createDataFrame(pairs, "loser long, survivor long")


def test_chains_stars_and_circles(spark):
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(k, 999) for k in range(200, 260)]
    assert got(M.closure(plan(spark, *chain, *star, (999, 1_000), (7, 7), (8, None)))) == sorted([(a, 140) for a, _ in chain] + [(a, 1_000) for a, _ in star] + [(999, 1_000)], key=repr)
    assert got(M.closure(plan(spark, (1, 2), (2, 3), (3, 1), (9, 2), (0, 9)))) == [(0, 1), (2, 1), (3, 1), (9, 1)]
    assert got(M.closure(plan(spark, (5, 4), (5, 3), (3, 2)))) == [(3, 2), (5, 2)]
    assert got(M.closure(plan(spark))) == []


def test_random_plans_end_where_a_walk_ends(spark):
    rng = random.Random(3)
    steps = {k: rng.randrange(k) for k in range(1, 600) if rng.random() < 0.9}

    def end(k):
        while k in steps:
            k = steps[k]
        return k

    assert got(M.closure(plan(spark, *steps.items()))) == sorted(((k, end(k)) for k in steps), key=repr)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(M, "store", lambda df, path, own=M.store: rounds.append(1) or own(df, path))
    assert got(M.closure(plan(spark, *[(k, k + 1) for k in range(200)])), "survivor")[0] == (200,)
    assert len(rounds) <= 10


@pytest.fixture
def opinions(spark):
    rows = [(1, 7, "2020-01-01", "A20-0001", "State v. Ann Lee", "", None), (2, 7, "2020-01-01", "a200001", "State v. Lee", "1 N.W.2d 2", None), (3, 7, "2020-01-01", "No. A20-1", "Smith v. Jones", "x", None),
            (4, 7, "2020-01-02", "a200001", "State v. Lee", "x", None), (5, 8, "2020-01-01", "a200001", "State v. Lee", "x", None), (6, 7, "2020-01-01", "a200001", "", "2 N.W.2d 3", [3])]
    return spark.createDataFrame(rows, "id long, court_id long, release_date string, case_number string, title string, reporter_cite string, holding_source_paras array<int>").selectExpr("*", "'' AS disposition").withColumn("release_date", M.F.to_date("release_date"))


def test_pairs_are_gated_by_court_date_and_caption(spark, opinions):
    assert got(M.discovered_pairs(opinions)) == [(2, 1), (6, 1)]
    asked = plan(spark, (3, 1), (4, 1), (5, 1), (2, 1), (77, 1))
    assert got(M.reviewed_pairs(asked, opinions)) == [(2, 1)] and got(M.reviewed_pairs(asked, opinions, trust_titles=True)) == [(2, 1), (3, 1)]


def test_fields_and_children(spark, opinions):
    p = plan(spark, (2, 1), (6, 2))
    kids = lambda rows, schema: spark.createDataFrame(rows, f"opinion_id long, {schema}")
    out = M.merge_opinions(
        {
            "opinions": opinions,
            "votes": kids([(1, 50, "A"), (2, 50, "B"), (2, 51, "C"), (6, 51, "D"), (9, 50, "E")], "judge_id long, vote_type string"),
            "statutes": kids([(2, "s"), (6, "t"), (3, "u"), (3, "u")], "slug string"),
            "holdings": kids([(1, "own"), (2, "lost")], "text string"),
            "tags": kids([(1, 5), (6, 5), (6, 6)], "tag_id long"),
            "parse_logs": kids([(1, "a"), (6, "a")], "log string"),
            "vectors": kids([(1, "v"), (2, "w")], "v string"),
            "edges": spark.createDataFrame([(2, 1, "c", "bulk"), (1, 9, "c", "bulk"), (2, 9, "c", "bulk"), (2, 9, "d", "bulk"), (8, 1, "c", "bulk"), (8, 6, "e", "bulk"), (8, 2, "e", "other"), (8, 6, "f", "other"), (2, None, "z", "bulk"), (7, 7, "q", "bulk"), (3, 9, "c", "bulk"), (3, 9, "c", "bulk")], "citing_id long, cited_id long, cite string, source string"),
        },
        p,
    )
    kept = {r.id: r for r in out["opinions"].collect()}
    assert sorted(kept) == [1, 3, 4, 5] and kept[1].reporter_cite == "1 N.W.2d 2" and kept[1].holding_source_paras == [3] and kept[3].reporter_cite == "x"
    assert got(out["votes"]) == [(1, 50, "A"), (1, 51, "C"), (9, 50, "E")]
    assert got(out["statutes"]) == [(1, "s"), (3, "u"), (3, "u")] and got(out["holdings"]) == [(1, "own")]
    assert got(out["tags"]) == [(1, 5), (1, 6)] and got(out["parse_logs"]) == [(1, "a"), (1, "a")] and got(out["vectors"]) == [(1, "v")]
    assert got(out["edges"]) == sorted([(1, 9, "c", "bulk"), (1, 9, "d", "bulk"), (8, 1, "c", "bulk"), (8, 1, "e", "other"), (1, None, "z", "bulk"), (7, 7, "q", "bulk"), (3, 9, "c", "bulk"), (3, 9, "c", "bulk")], key=repr)


def test_judges(spark):
    judges = spark.createDataFrame([(1, "", "UNKNOWN", False), (2, "bio", "ACTIVE", True), (3, "other", "UNKNOWN", False)], "id long, bio_summary string, status string, is_currently_seated boolean")
    votes = spark.createDataFrame([(9, 1, "MAJORITY_JOIN"), (9, 3, "DISSENT_AUTHOR"), (8, 4, "RECUSED")], "opinion_id long, judge_id long, vote_type string")
    people, cast = M.merge_judges(judges, votes, plan(spark, (3, 2), (2, 1)))
    assert got(people) == [(1, "bio", "ACTIVE", True)] and got(cast) == [(8, 4, "RECUSED"), (9, 1, "DISSENT_AUTHOR")]
