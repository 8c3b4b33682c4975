import math

import numpy as np
import pytest

from lexlake.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank string"


def table(spark, n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], 0, 1.0, "clash") for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same, 0, 1.0, "clash") for i in range(200)]  # a vector that a quarter of the rows hold
    rows += [(50_000, None, 0, 1.0, ""), (50_100, [], 0, 1.0, ""), (50_200, [float("nan")] * dim, 0, 1.0, ""), (50_300, [None] * dim, 0, 1.0, ""), (50_400, [float("inf")] * dim, 0, 1.0, ""), (50_500, [0.0] * dim, 0, 1.0, ""), (None, same, 0, 1.0, ""), (50_600, [1.0, 2.0], 0, 1.0, ""), (50_601, [1.0, 3.0], 0, 1.0, "")]
    rows += [rows[3]]  # a row that repeats
    return spark.createDataFrame(rows, SCHEMA)


def usable(df, zero):
    out = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not np.isfinite(x) for x in v) or (not zero and not any(v)):
            continue
        out[r.vec_id] = np.asarray(v, float)
    return out


def brute(vectors, score, k=10):
    out = {}
    for q, v in vectors.items():
        if q % 100 == 0:
            found = sorted((score(v, w), i) for i, w in vectors.items() if i != q and len(w) == len(v))[:k]
            out[q] = [(i, s) for s, i in found]
    return out


def exact(df, **options):
    got = {}
    for r in topk.largest(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, -r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


def whole(v):
    return [math.floor(1024 * float(x)) for x in v]


def brute_products(vectors):
    own = {i: whole(v) for i, v in vectors.items()}
    return {q: w for q, w in brute(own, lambda a, b: -sum(x * y for x, y in zip(a, b))).items() if w}


def test_exact_products(spark):
    df = table(spark)
    assert exact(df, block_rows=64, query_rows=4) == brute_products(usable(df, True))


@pytest.mark.parametrize("size", [20_000.0, 1e5, 4e5])
def test_exact_products_of_large_components(spark, size):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 6)) * size * rng.uniform(0.01, 1, (300, 1))
    df = spark.createDataFrame([(i, [float(x) for x in row], 0, 0.0, "") for i, row in enumerate(v)], SCHEMA.replace("float", "double"))
    assert exact(df, block_rows=32, query_rows=2) == brute_products(dict(enumerate(v)))


def test_scores_beyond_64_bits(spark):
    rows = [(0, [2e6, 1.0], 0, 0.0, ""), (1, [2e6, 5.0], 0, 0.0, ""), (2, [-3e9, 1.0], 0, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert exact(df, k=1)[0] == [(1, -(1024**2 * (4 * 10**12 + 5)))]  # the far lower score is no result
    with pytest.raises(Exception, match="no 64-bit integer"):
        exact(spark.createDataFrame([(0, [3e9, 1.0], 0, 0.0, ""), (1, [3e9, 5.0], 0, 0.0, "")], SCHEMA.replace("float", "double")))


def check_nearest(df, least, **options):
    distance = lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))
    vectors, got = usable(df, False), {}
    want = {q: w for q, w in brute(vectors, distance).items() if w}
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.score == pytest.approx(distance(vectors[r.query_id], vectors[r.vec_id]))
    assert got.keys() == want.keys()
    for q, w in got.items():
        assert w == sorted(w, key=lambda x: (x[1], x[0])) and len(w) == len(want[q]) == len({i for i, _ in w})
    hits = sum(len({i for i, _ in w} & {i for i, _ in got[q]}) for q, w in want.items())
    assert hits >= least * sum(map(len, want.values()))


def test_nearest(spark):
    check_nearest(table(spark), 0.9, list_rows=64, query_rows=4)


def test_recall_with_a_budget_of_a_fortieth(spark):
    """8,000 vectors without clusters in 24 dimensions: a query looks into 48 of 500 files and reranks 200 vectors."""
    check_nearest(table(spark, n=8_000, dim=24), 0.9, budget=200)


@pytest.mark.parametrize("n", [300, 3_000])
def test_recall_at_small_sizes(spark, n):
    """The same steps at every size: 64 dimensions without clusters, production parameters."""
    check_nearest(table(spark, n=n, dim=64), 0.9)


def test_all_that_go_on(spark):
    check_nearest(table(spark, n=2_000), 0.95, budget=None, per_list=64)


def test_few_files_still_give_k(spark):
    check_nearest(table(spark, n=2_000), 0.2, asked=1, posted=1, budget=20)


def test_empty(spark):
    df = table(spark).where("vec_id = -1")
    assert ann.nearest(df).collect() == [] and topk.largest(df).collect() == []


def test_coordinate_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(0)
    for scale in (1, 50):
        v = np.floor(rng.normal(size=(400, 8)) * 1024 * rng.uniform(1, scale, (400, 1)))
        bucket = topk.Bucket(v, np.arange(400)[:, None])
        for q in v[:20]:
            scores = bucket.vectors @ q
            bound = float(np.sort(scores)[-10])
            for high in (0.0, 0.7, 2.0):
                assert set(np.flatnonzero(scores >= bound)) <= set(bucket.candidates(q, bound / np.sqrt((q**2).sum()) * topk.SLACK, high))
