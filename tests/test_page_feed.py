"""A growing feed of saved pages: each item once, few pages looked at, any way of writing keys."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexlake.sources import page_feed as P


def crawl(path, name, pages, done=True):
    (path / name).mkdir(parents=True)
    for k, ids in enumerate(pages, 1):
        (path / name / f"{k}.json").write_text(json.dumps({"results": [x if isinstance(x, dict) else {"id": x, "caseName": f"c{x}"} for x in ids]}))
    if done:
        (path / name / P.DONE).write_text("")


def drain(spark, path):
    spark.dataSource.register(P.PageFeed)
    stream = spark.readStream.format("page_feed").load(str(path / "in"))
    stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "mark")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.id, r.crawl) for r in spark.read.parquet(str(path / "out")).collect())


def test_each_item_once_over_growing_crawls(spark, tmp_path):
    src = tmp_path / "in"
    crawl(src, "1", [[5, 4], [4, 3], [], [2, 1]])  # 4 moved down a page while the crawl went on; a page without items
    assert drain(spark, tmp_path) == [(k, "1") for k in range(1, 6)]
    assert drain(spark, tmp_path) == [(k, "1") for k in range(1, 6)]  # nothing new
    crawl(src, "2", [[9, 8], [7, 5]])  # only down to what was known
    crawl(src, "3", [[11, 10], [9, 8], [7, 5], [4, 3], [2, 1]])
    crawl(src, "4", [[99]], done=False)  # still being saved
    crawl(src, "5", [])
    assert drain(spark, tmp_path) == [(k, "1") for k in range(1, 6)] + [(7, "2"), (8, "2"), (9, "2"), (10, "3"), (11, "3")]
    crawl(src, "6", [[12, 11]])
    assert drain(spark, tmp_path)[-1] == (12, "6") and len(drain(spark, tmp_path)) == 11
    spark.dataSource.register(P.PageFeed)
    assert sorted((r.id, r.crawl) for r in spark.read.format("page_feed").load(str(src)).collect()) == drain(spark, tmp_path)  # the same as a table


def test_keys_of_all_endpoints(spark, tmp_path):
    a = {"cluster_id": 7, "docketNumber": "A1", "caseName": "x", "dateFiled": "2024-01-02", "court_id": "minn", "opinions": [{"id": 70}, {"id": None}]}
    b = {"id": "6", "docket_number": None, "case_name": "y", "sub_opinions": ["https://x.example/api/opinions/61/", 62, {"id": 63}, None, "none"], "extra": {"id": 1}}
    crawl(tmp_path, "1", [[a, b, {"case_name": "without an id"}, {"id": None}]])
    spark.dataSource.register(P.PageFeed)
    got = spark.read.format("page_feed").load(str(tmp_path)).orderBy("id").collect()
    assert [tuple(r)[:6] for r in got] == [(6, None, "y", None, None, [61, 62, 63]), (7, "A1", "x", "2024-01-02", "minn", [70])]


def test_no_crawl_and_empty_crawls(spark, tmp_path):
    spark.dataSource.register(P.PageFeed)
    assert spark.read.format("page_feed").load(str(tmp_path / "none")).count() == 0
    crawl(tmp_path / "in", "1", [[], []])
    assert spark.read.format("page_feed").load(str(tmp_path / "in")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pages_are_found_by_halving(tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(10_000), 1_000), reverse=True)
    pages = [ids[k : k + 5] for k in range(0, 1_000, 5)]
    for k in rng.sample(range(len(pages)), 20):
        pages.insert(k, [])
    crawl(tmp_path, "1", pages)
    feed, looked = P.Feed(str(tmp_path)), []
    items = feed.items
    monkeypatch.setattr(feed, "items", lambda c, k: looked.append(k) or items(c, k))
    for known in (-1, ids[-1], ids[0], 10_000, *rng.sample(range(10_000), 10)):
        looked.clear()
        assert feed.newer("1", known) == max((k for k, p in enumerate(pages, 1) if any(x > known for x in p)), default=0)
        assert len(looked) <= 8 + 20


def test_saved_and_read_back(spark, tmp_path):
    rows = spark.range(1_003).withColumn("id", F.col("id") * 3)
    P.save_pages(rows, F.struct("id", F.concat(F.lit("c"), "id").alias("caseName")), str(tmp_path), "a", size=10)
    feed = P.Feed(str(tmp_path))
    assert feed.pages("a") == 101 and [x["id"] for x in feed.items("a", 1)] == [3_006 - 3 * k for k in range(10)] and len(feed.items("a", 101)) == 3
    spark.dataSource.register(P.PageFeed)
    got = spark.read.format("page_feed").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 101 and got.where("case_name = concat('c', id)").select("id").distinct().count() == got.count() == 1_003


def test_many_pages_are_read_in_runs(spark, tmp_path):
    pages = [[3_000 - 2 * k, 2_999 - 2 * k] for k in range(1_000)]
    for k in range(9, 1_000, 10):
        pages[k].insert(0, pages[k - 1][-1])  # moved down a page, over the bounds of runs too
    pages[16], pages[520] = [], []
    crawl(tmp_path, "1", pages)
    stream = P.FeedStream({"path": str(tmp_path)})
    parts = stream.partitions(dict(P.NOTHING), stream.latestOffset())
    assert len(parts) <= 128 and [k for p in parts for k in range(p.first, p.last + 1)] == list(range(1, 1_001))
    looked, items = [], stream.feed.items
    stream.feed.items = lambda c, k: looked.append(k) or items(c, k)
    got = [(r[0], r[-1]) for p in parts for r in stream.read(p)]
    want = {x: k for k, page in reversed(list(enumerate(pages, 1))) for x in page}
    assert got == sorted(want.items(), reverse=True)
    assert len(looked) <= 1_000 + len(parts) + 2
    spark.dataSource.register(P.PageFeed)
    assert sorted((r.id, r.page) for r in spark.read.format("page_feed").load(str(tmp_path)).collect()) == sorted(want.items())
