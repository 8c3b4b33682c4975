import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlake.llm import mixing, ngram_join, quality

DOCS = "doc_id long, text string, score double, copies int, rate string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def shingle_set(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def near_copy_rows():
    """Two groups of near copies, exact copies, chains, and odd rows."""
    rng, rows = random.Random(5), []
    for base in range(2):
        text = words(rng, 120).split()
        for _ in range(40):
            t = text[:]
            for _ in range(rng.randrange(4)):
                t[rng.randrange(120)] = words(rng, 1)
            rows.append(" ".join(t))
    rows += [rows[0]] * 30 + [rows[0].upper() + "!", rows[0].replace(" ", "  ")]
    rows += [words(rng, 100) for _ in range(40)] + ["", None, "...", "one", "one", "One two", "a b c d e", "word " * 20_000]
    return [(i, t, 0.0, 1, "") for i, t in enumerate(rows)] + [(None, rows[0], 0.0, 1, ""), (3, rows[3], 0.0, 1, "")]


def brute_links(rows):
    sets = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    near = {}
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets):
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y):
                near.setdefault(a, []).append(b)
    root = {}

    def mark(a, r):
        stack = [a]
        while stack:
            k = stack.pop()
            if k not in root:
                root[k] = r
                stack += near.get(k, [])

    for a in sorted(range(len(sets)), key=lambda k: sets[k][0]):
        mark(a, sets[a][0])
    return sorted((sets[a][0], root[a], len(near.get(a, []))) for a in range(len(sets)))


@pytest.mark.parametrize("chunk", [(256, 128), (8, 8)])
def test_join_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "NODE", chunk[0])
    monkeypatch.setattr(ngram_join, "GROUP", chunk[1])
    rows = near_copy_rows()
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == brute_links(rows)
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]


def test_link_pairs(spark):
    rows = near_copy_rows()
    first, sets = {}, {}
    for i, t, *_ in rows:
        if i is not None and (s := frozenset(shingle_set(t))):
            first[s] = min(first.get(s, i), i)
    sets = {i: s for s, i in first.items()}
    want = {tuple(sorted((i, j))) for i, x in sets.items() for j, y in sets.items() if i < j and len(x & y) >= 0.8 * len(x | y)}
    got = ngram_join.Join(spark.createDataFrame(rows, DOCS)).link_pairs().collect()
    assert {tuple(sorted((r.doc_a, r.doc_b))) for r in got} == want and len(got) == len(want) and all(r.jaccard >= 0.8 for r in got)


def test_one_of_each(spark):
    rows = near_copy_rows()
    df = spark.createDataFrame(rows, DOCS)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r for _, r, _ in brute_links(rows)}) and ids.count(None) == 1
    assert ngram_join.one_of_each(df.limit(0)).collect() == [] and ngram_join.near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [(bytes([a]), bytes([b])) for a, b in zip(order, order[1:]) if a < 250]
    got = ngram_join.components(spark, spark.createDataFrame(links, "a binary, b binary")).collect()
    assert {bytes(r.root) for r in got} == {bytes([0])} and len({bytes(r.key) for r in got}) == 200


def test_runs_stay_whole():
    import pyarrow as pa

    keys = [k for k in range(40) for _ in range((k * 7) % 5 + 1)]
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size])], names=["k"]) for i in range(0, len(keys), size)]
        tables = [t["k"].to_pylist() for t in ngram_join.groups_of(iter(batches), ("k",))]
        assert sum(tables, []) == keys and all(not set(a) & set(b) for a, b in zip(tables, tables[1:]))


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity between 0.8 and 0.85, against brute force."""
    rng, rows, want = random.Random(9), [], set()
    for k in range(400):
        t = words(rng, 200).split()
        other = t[:]
        for at in rng.sample(range(0, 200, 8), rng.randrange(3, 5)):  # a changed word changes five shingles
            other[at] = words(rng, 1)
        a, b = shingle_set(" ".join(t)), shingle_set(" ".join(other))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            want.add((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(t), 0.0, 1, ""), (2 * k + 1, " ".join(other), 0.0, 1, "")]
    join = ngram_join.Join(spark.createDataFrame(rows, DOCS))
    got = {tuple(sorted((r.doc_a, r.doc_b))) for r in join.link_pairs().collect()}
    assert len(want) > 100 and len(want & got) >= 0.99 * len(want)
    assert ngram_join.shortest_prefix(0.8, 0.9999) <= join.depth <= ngram_join.LABEL


def test_prefix_is_shortened_only_as_needed(spark):
    links = lambda counts: spark.createDataFrame([(d, a) for d, a, n in counts for _ in range(n)], "depth int, agree int")
    assert ngram_join.matched_prefix(links([(8, 256, 50), (6, 100, 50)]), 0.8, 0.99, 6) == 8
    assert ngram_join.matched_prefix(links([(8, 256, 50), (7, 220, 50), (6, 220, 1)]), 0.8, 0.99, 6) == 7
    assert ngram_join.matched_prefix(links([(8, 256, 50), (6, 220, 5)]), 0.8, 0.99, 6) == 6


def test_one_id_with_many_texts(spark):
    rng = random.Random(6)
    base = words(rng, 100)
    rows = [(7, base + " " + words(rng, 2), 0.0, 1, "") for _ in range(60)] + [(8, base, 0.0, 1, "")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)


def labelled_rows(n=300):
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 1
        text = words(rng, rng.randrange(30, 200))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text = " ".join(w + " zzfoul" if k % 20 == 3 else w for k, w in enumerate(text.split()))
        rows.append((i, text, 0.0, 1, ""))
        labels.append((i, 0 if bad else 1, int(toxic), "x"))
    rows += [(n, None, 0.0, 1, ""), (n + 1, "", 0.0, 1, ""), (None, "no id", 0.0, 1, ""), (n + 2, "long " * 100_000, 0.0, 1, ""), (0, rows[0][1], 0.0, 1, "")]
    labels += [(n, None, None, ""), (None, 1, 0, ""), (n + 9, 1, 0, ""), (1, 7, 3, "")]
    return rows, labels


LABELS = "doc_id long, quality int, toxic int, score string"


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled_rows()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality.classify(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, q, *_ in labels[:300]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    again = {r.doc_id: r.score for r in quality.classify(docs, lab.where("crc32(cast(doc_id as string)) % 3 <> 1")).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)  # held-out labels are never read


@pytest.mark.parametrize("kinds", [(), (1,), (0,)])
def test_quality_without_one_kind_of_label(spark, kinds):
    rows, labels = labelled_rows(40)
    lab = spark.createDataFrame([x for x in labels if x[1] in kinds], LABELS)
    got = quality.classify(spark.createDataFrame(rows, DOCS), lab).collect()
    assert len(got) == len(rows) and {r.predicted for r in got} == ({0} if kinds == (0,) else {1})


def test_texts_without_evidence_get_the_share_of_good_ones(spark, sf):
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, lab)
    share = 1 / (1 + np.exp(-model.prior))
    assert model.scores([model.features("")])[0] == pytest.approx(share)
    few = model.scores([model.features(t) for t in ("a", "no", ".")])
    assert np.abs(few - share).max() < 0.1


def test_scores_equal_those_of_the_model_alone(spark):
    rows, labels = labelled_rows()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs, lab)
    want = {(i, t or ""): float(model.scores([model.features(t or "")])[0]) for i, t, *_ in rows}
    got = quality.score(docs.select("doc_id", "text"), model, ("doc_id", "text")).collect()
    assert all(r.score == pytest.approx(want[r.doc_id, r.text or ""], abs=1e-12) for r in got) and len(got) == len(rows)


def test_accepted_rows_keep_their_columns(spark):
    rows, labels = labelled_rows()
    docs, lab = spark.createDataFrame(rows, DOCS).withColumn("predicted", F.lit("clash")), spark.createDataFrame(labels, LABELS)
    kept = quality.accepted(docs, quality.fit(docs, lab))
    want = sorted(r.doc_id for r in quality.classify(docs, lab).collect() if r.predicted == 1 and r.doc_id is not None)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


WEIGHTS = {"clean": 0.8, "low": 0.15, "toxic": 0.05}


def test_mixing_meets_reachable_targets(spark):
    rows, labels = labelled_rows(600)
    docs, lab = spark.createDataFrame(rows[:600], DOCS), mixing.quality_domains(spark.createDataFrame(labels, LABELS))
    model = mixing.fit(docs, lab, WEIGHTS)
    assert model.domains == ["clean", "low", "toxic"] and "zzfoul" in model.vocabulary
    got = mixing.mix(docs, lab, WEIGHTS).collect()
    total = np.zeros(3)
    for r in got:
        assert r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1)
        total += r.rate * r.n_tokens * np.array(r.posteriors)
    assert total == pytest.approx(model.reached, rel=1e-6)
    assert np.abs(total / total.sum() - [0.8, 0.15, 0.05]).max() < 0.01


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2), (0.02, 0.02, 0.96), (1.0, 0.0, 0.0)])
def test_rates_are_the_least_squares_solution(spark, weights):
    """Against brute force: many plain projected-gradient steps over all rates in memory, and the conditions of an optimum."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet((0.4, 0.3, 0.2), 300)
    n = rng.integers(0, 500, 300).astype(float)
    slim = spark.createDataFrame([(float(x), *map(float, q)) for x, q in zip(n, p)], "`#n` double, `#p0` double, `#p1` double, `#p2` double")
    model = mixing.Mixture(["a", "b", "c"], [], 0, [[0.0]] * 3)
    mixing.fit_rates(slim, model, dict(zip("abc", weights)), ridge=0.01, most_steps=400, tolerance=1e-7)
    got = np.array([r.r for r in slim.select("#n", "#p0", mixing.rate(model).alias("r")).collect()])
    total, target = n.sum(), np.array(model.targets)
    assert target == pytest.approx(np.array(weights) / sum(weights) * total)
    a, curve = (n[:, None] * p).T / total, 1 / ((n[:, None] * p * p).sum(0) / total)

    def slope(r):  # by token
        return p @ (curve * (a @ r - target / total)) + 0.01 * (r - 1)

    r = np.ones(300)
    for _ in range(60_000):
        r = np.maximum(0, r - model.size * slope(r))
    assert np.abs(r - got)[n > 0].max() < 1e-3
    g = slope(got)[n > 0]
    assert g.min() > -1e-4 and np.abs(g * (got[n > 0] > 1e-6)).max() < 1e-4
    assert model.reached == pytest.approx(a @ got * total, abs=1e-3 * total)


@pytest.mark.parametrize("most", [1.0, 1.5])
def test_rates_have_an_upper_bound(spark, most):
    """Against brute force over the box of rates; targets that cannot be reached are told, not forced."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet((0.9, 0.05), 300)
    n = rng.integers(1, 500, 300).astype(float)
    slim = spark.createDataFrame([(float(x), *map(float, q)) for x, q in zip(n, p)], "`#n` double, `#p0` double, `#p1` double")
    model = mixing.Mixture(["a", "b"], [], 0, [[0.0]] * 2)
    mixing.fit_rates(slim, model, {"a": 0.6, "b": 0.4}, budget="largest", ridge=0.01, most_steps=600, tolerance=1e-7, most_rate=most)
    got = np.array([r.r for r in slim.select("#n", "#p0", mixing.rate(model).alias("r")).collect()])
    total, target = n.sum(), np.array(model.targets)
    a, curve = (n[:, None] * p).T / total, 1 / ((n[:, None] * p * p).sum(0) / total)
    r = np.ones(300)
    for _ in range(20_000):
        r = np.clip(r - model.size * (p @ (curve * (a @ r - target / total)) + 0.01 * (r - 1)), 0, most)
    assert got.max() <= most and np.abs(r - got).max() < 1e-3 and "b" in mixing.unmet(model)


def test_words_never_share_a_bucket(spark):
    words = [f"w{k}" for k in range(3_000)]
    seed, buckets, at = mixing.without_collisions(spark, words, seeds=4)
    assert len(set(at.values())) == 3_000 and max(at.values()) < buckets


def test_mixing_odd_rows(spark):
    rows, labels = labelled_rows(40)
    docs, lab = spark.createDataFrame(rows, DOCS), mixing.quality_domains(spark.createDataFrame(labels, LABELS))
    got = mixing.mix(docs, lab, WEIGHTS).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id == 40} == {0}
    assert mixing.mix(docs.limit(0), lab, WEIGHTS).collect() == []
    equal = mixing.mix(docs, lab.limit(0), WEIGHTS).collect()
    assert len(equal) == len(rows)
    kept = mixing.resampled(docs, lab, WEIGHTS)
    assert kept.columns == docs.columns
    counts = {r.doc_id: r.n for r in kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert counts == {k: n for k, n in want.items() if n}


def test_mixing_has_no_python_in_its_plan(spark, capsys):
    rows, labels = labelled_rows(40)
    mixing.mix(spark.createDataFrame(rows, DOCS), mixing.quality_domains(spark.createDataFrame(labels, LABELS)), WEIGHTS).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
