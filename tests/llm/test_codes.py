import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
import xxhash

from lexlake.llm import negatives, part_codes, queries, simhash

SCHEMA = "vec_id long, embedding array<{0}>, label int, score double, error string, cluster int"


def vectors(spark, n=400, dim=16, seed=5, scale=1.0, kind="float"):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32) * np.float32(scale)
    rows = [(i, [float(x) for x in v[i]], None if i % 50 == 9 else int(rng.integers(0, 4)), 1.0, "clash", 1) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same, 2, 1.0, "clash", 1) for i in range(150)]  # a vector that a quarter of the rows hold
    rows += [rows[3], rows[100], (100, rows[200][1], 1, 1.0, "two rows of an id", 1)]
    rows += [(9_000, None, 0, 1.0, "", 1), (9_100, [], 0, 1.0, "", 1), (9_200, [float("nan")] * dim, 0, 1.0, "", 1), (9_300, [None] * dim, 0, 1.0, "", 1), (9_400, [float("inf")] * dim, 0, 1.0, "", 1), (9_500, [0.0] * dim, 0, 1.0, "", 1), (None, same, 0, 1.0, "", 1)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA.format(kind)).repartition(3)


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(r.vec_id, r.label, [math.floor(scale * x) for x in r.embedding]) for r in rows if finite(r.embedding) and len(r.embedding) % parts == 0]
    width = len(kept[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    books = [[cut(min(v for i, _, v in kept if i == k))[p] for k in ids] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, s: min((far(s, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, label, v in kept:
        found = [near(p, s) for p, s in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[label], sha) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("scale, kind", [(1.0, "float"), (1e4, "double")])
def test_part_codes(spark, scale, kind, monkeypatch):
    monkeypatch.setattr(part_codes, "BLOCK", 1_000)
    df = vectors(spark, scale=scale, kind=kind)
    got = sorted((tuple(r) for r in part_codes.encode(df).collect()), key=repr)
    assert got == brute_codes(df.collect()) and len(got) > 550


def test_part_codes_of_huge_components_and_few_rows(spark):
    rows = [(i, [float((i + 1) * 10 ** (k // 2 + 2)) for k in range(8)], i % 2, 0.0, "", 0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA.format("double"))
    got = [tuple(r) for r in part_codes.encode(df, entries=2).orderBy("vec_id").collect()]
    assert got == brute_codes(df.collect(), entries=2)
    huge = df.selectExpr("vec_id", "transform(embedding, x -> x * 1e30) AS embedding", "label")
    assert part_codes.encode(huge).select("error").distinct().collect()[0].error == 0  # 5 rows, 5 entries


def test_part_codes_by_salted_labels_and_of_two_lengths(spark, monkeypatch):
    monkeypatch.setattr(part_codes, "MOST_LABELS", 1)
    df = vectors(spark)
    short = df.where("size(embedding) = 16").selectExpr("vec_id", "slice(embedding, 1, 8) AS embedding", "CAST(NULL AS int) AS label")
    odd = df.where("size(embedding) = 16").selectExpr("vec_id", "slice(embedding, 1, 9) AS embedding", "label")
    got = part_codes.encode(df.select("vec_id", "embedding", "label").union(odd)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(df.collect())
    both = part_codes.encode(df.select("vec_id", "embedding", "label").where("label IS NOT NULL").union(short)).groupBy("codebooks_sha256").count().collect()
    assert {r.codebooks_sha256 for r in both} == {brute_codes(df.where("label IS NOT NULL").collect())[0][4], brute_codes(short.collect())[0][4]}


def brute_negatives(rows, every=100, k=5, scale=256):
    kept = sorted({(r.vec_id, r.label, tuple(math.floor(scale * x) for x in r.embedding)) for r in rows if r.vec_id is not None and r.label is not None and finite(r.embedding)})
    out = set()
    for anchor in (r for r in kept if r[0] % every == 0):
        dot = lambda v: sum(x * y for x, y in zip(v, anchor[2]))  # noqa: E731, B023
        scored = sorted(((-dot(v), i, label) for i, label, v in kept if i != anchor[0] and len(v) == len(anchor[2])))
        for s, i, _ in [x for x in scored if x[2] == anchor[1]][:k]:
            window = [x for x in scored if x[2] != anchor[1] and -80 * s <= -100 * x[0] <= -100 * s][:k]
            out |= {(anchor[0], i, rank + 1, j, -s, -t) for rank, (t, j, _) in enumerate(window)}
    return out


@pytest.mark.parametrize("dim, options", [(16, {}), (4, {"block_rows": 16, "waves": (1, 3), "pack_rows": 4}), (2, {"block_rows": 8, "waves": (2,)})])
def test_hard_negatives(spark, dim, options):
    df = vectors(spark, dim=dim)
    got = [tuple(r) for r in negatives.mine(df, every=10, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    want = brute_negatives(df.collect(), every=10)
    assert set(got) == want and len(got) == len(want) > 100


def test_clusters_are_skipped(spark):
    """On clustered vectors most blocks are never visited, and the result stays whole."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 20
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=8) * 0.3], int(rng.integers(0, 3)), 0.0, "", 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA.format("double"))
    seen = []
    planned = negatives.planned
    try:
        negatives.planned = lambda *a: seen.append(out := planned(*a).cache()) or out
        got = {tuple(r) for r in negatives.mine(df, every=100, block_rows=32, waves=(2, 8)).collect()}
    finally:
        negatives.planned = planned
    assert got == brute_negatives(df.collect())
    visits = sum(v.selectExpr("sum(size(queries))").first()[0] or 0 for v in seen)
    assert visits < 0.5 * 9 * 6 * 30  # 9 anchors and 45 pairs, 30 blocks and more


def test_hard_negatives_of_large_components(spark):
    df = vectors(spark, scale=2e5, kind="double").where("vec_id < 300")
    got = [tuple(r) for r in negatives.mine(df).collect()]
    assert set(got) == brute_negatives(df.collect()) and got


def test_empty_vectors(spark):
    df = vectors(spark).where("vec_id = -1")
    assert part_codes.encode(df).collect() == [] and negatives.mine(df).collect() == []
    assert negatives.mine(vectors(spark).where("label = 1")).collect() == []


@pytest.mark.parametrize("name", ["op2_norm_bucket_topk", "op11_part_codes", "op12_hard_negatives"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False))) and len(got)


def plain_fingerprint(text):
    words, at = [], ""
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""):
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            words, at = words + ([at] if at else []), ""
        else:
            at += c
    words += [at] if at else []
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, reach=3):
    """The smallest id reachable from each row of (id, fingerprint)."""
    nodes = sorted({f for _, f in prints})
    root = {f: f for f in nodes}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= reach:
                root[top(a)] = top(b)
    least = {}
    for i, f in prints:
        least[top(f)] = min((x for x in (least.get(top(f)), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[top(f)]) for i, f in prints), key=repr)


def test_fingerprints(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \t\n\x0b\x0c\r ", "One", "ÄÖ x y Z", " a b", "a b c", "A  B\tC d", "ß" * 3_000, "x" * 5_000 + " y z"]
    texts += [" ".join(rng.choice(["rule", "Of", "law", "Über", "x　y", "the"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    want = [plain_fingerprint(t) for t in texts]
    for window, hashes in ((1 << 20, 1 << 14), (7, 5)):
        monkeypatch.setattr(simhash, "WINDOW", window)
        monkeypatch.setattr(simhash, "HASHES", hashes)
        assert [simhash.fingerprint((t or "").encode()) & (2**64 - 1) for t in texts] == want


def test_near_pairs_of_trees():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 12, np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12, np.uint64)) for _ in range(40)] + [base]))
    for cut in (1, 7, 100, 300):
        x, y = codes[:cut], codes[cut:]
        i, j = simhash.near_pairs(x, y, 3)
        want = np.argwhere(np.bitwise_count(x[:, None] ^ y[None]) <= 3)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("leaf, small, ordered", [(1_024, 32, 200_000), (16, 4, 300)])
@pytest.mark.parametrize("reach", [0, 2, 3])
def test_components_of_fingerprints(spark, monkeypatch, leaf, small, ordered, reach):
    """Chains, stars, a group of a third of the rows, and fingerprints that share their upper bits."""
    for name, value in (("LEAF", leaf), ("SMALL", small), ("SORTED", ordered), ("UPPER", 4)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(8)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    seeds = [rng.getrandbits(64) for _ in range(150)]
    prints = [flip(f, rng.randint(0, 4)) for f in seeds for _ in range(3)]
    prints += [(0xABCD << 48) | rng.getrandbits(12) << 20 for _ in range(200)] + [(0xABCD << 48) | rng.getrandbits(48) for _ in range(200)] + [0, 2**64 - 1, 1, 7, 15]
    chain = rng.getrandbits(64)
    for _ in range(20):
        prints.append(chain := flip(chain, 3))
    rows = [(k if k % 40 else None, f) for k, f in enumerate(prints + prints[:100])]
    rng.shuffle(rows)
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in rows]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n: docs)
    got = simhash.near_duplicates(spark.createDataFrame(signed, "doc_id long, fingerprint long").repartition(4), reach=reach).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, reach)


def test_near_duplicates_of_texts(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.choice([2, 20, 200, 2_000]))) for _ in range(60)]
    near = [t.replace(t.split()[5], "other", 1) if len(t.split()) > 5 else t for t in texts]
    rows = [(k, t, "clash", 1) for k, t in enumerate([*texts, *near, *texts[:20], None, "", "   ", *[texts[3]] * 50])] + [(None, texts[5], "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, root int")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute_components([(i, plain_fingerprint(t)) for i, t, _, _ in rows])
    assert simhash.near_duplicates(df.where("doc_id < 0")).collect() == []
