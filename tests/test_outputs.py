"""Sitemaps with their commit, pages at any depth, ends of logs, parse logs."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexlake.operators import logs as L
from lexlake.operators import parse_logs as G
from lexlake.operators.paging import PagedList
from lexlake.sources import sitemaps as X
from lexlake.sources import tails


def urls(spark, n=25, size=10):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    op = frame([(k, k % 3, f"A & B <{k:03d}>") for k in range(n)], "id long, court_id long, case_number string")
    judges = frame([("ann", "2020-01-02"), ("bo", None), ("", None)], "slug string, created string")
    slugs = frame([("x",), ("y",), ("x",), (None,)], "slug string")
    return X.sitemap_urls(op, judges, slugs, slugs.limit(0), "https://h", size)


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) if folder.exists() else []


def test_sitemaps(spark, tmp_path):
    out = tmp_path / "out"
    X.write_sitemaps(urls(spark), str(out), "https://h")
    assert names(out) == ["sitemap-judges.xml", "sitemap-opinions-1.xml", "sitemap-opinions-2.xml", "sitemap-opinions-3.xml", "sitemap-static.xml", "sitemap-tags.xml", "sitemap.xml"]
    read = {f: [u.find("{*}loc").text for u in ET.parse(out / f).getroot()] for f in names(out)}
    assert read["sitemap.xml"] == [f"https://h/{f}" for f in names(out)[:-1]]
    assert [len(read[f"sitemap-opinions-{k}.xml"]) for k in (1, 2, 3)] == [10, 10, 5] and read["sitemap-tags.xml"] == ["https://h/tag/", "https://h/tag/x/", "https://h/tag/y/"]
    assert read["sitemap-judges.xml"] == ["https://h/judge/ann/", "https://h/judge/bo/"] and "<lastmod>2020-01-02</lastmod>" in (out / "sitemap-judges.xml").read_text()
    back = sorted((r.file, r["loc"]) for r in X.read_sitemaps(spark, str(out)).collect())
    assert back == sorted((f, u) for f, us in read.items() if f != "sitemap.xml" for u in us)
    X.write_sitemaps(urls(spark, 5), str(out), "https://h")  # fewer files than before: old ones go
    assert [f for f in names(out) if "opinions" in f] == ["sitemap-opinions-1.xml"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    out = tmp_path / "out"
    rows = urls(spark).withColumn("loc", F.when(F.col("file") == "sitemap-tags.xml", F.raise_error(F.lit("no more"))).otherwise(F.col("loc")))
    with pytest.raises(Exception, match="no more"):
        X.write_sitemaps(rows, str(out), "https://h")
    assert names(out) == []
    X.write_sitemaps(urls(spark), str(out), "https://h")
    before = {f: (out / f).read_text() for f in names(out)}
    with pytest.raises(Exception, match="no more"):
        X.write_sitemaps(rows, str(out), "https://h")
    assert {f: (out / f).read_text() for f in names(out)} == before


def test_pages(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 5)) for k in range(1_003)]
    stored = PagedList.write(spark.createDataFrame(rows, "id long, day int").repartition(5), str(tmp_path / "p"), F.desc("day"), F.col("id"), ranges=6)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert stored.total == 1_003 and len(stored.parts) > 1
    for number in (1, 2, 7, 40, 41):
        got = sorted((r.pos, r.id, r.day, r.total) for r in stored.page(number, 25).collect())
        assert got == [(p + 1, *want[p], 1_003) for p in range((number - 1) * 25, min(number * 25, 1_003))]
    assert stored.page(42, 25).collect() == [] == stored.page(-3, 25).collect()
    assert stored.page(5, 25).selectExpr("input_file_name()").distinct().count() <= 2
    assert sorted((r.page, r.id) for r in stored.first_rows(25).collect()) == [(k + 1, want[k * 25][0]) for k in range(41)]
    empty = PagedList.write(spark.createDataFrame([], "id long, day int"), str(tmp_path / "e"), "id")
    assert empty.total == 0 and empty.page(1, 10).collect() == []


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_tails(spark, tmp_path, block):
    rng = random.Random(block)
    files, lines = [], []
    for k, end in enumerate(("\n", "\n", "", "\n")):
        own = ["é" * rng.randint(0, 9) + "x" * rng.choice([0, 3, 30]) + f" {k}-{i}" for i in range(40)]
        own[5] = ""
        (tmp_path / f"log{k}").write_text("\n".join(own) + end)
        files.append(str(tmp_path / f"log{k}"))
        lines += own
    for n in (1, 39, 41, 100, 160, 900):
        assert [r.value for r in tails.tail(spark, files, n, block=block, line=4).collect()] == lines[-n:]


def test_logs_that_say_nothing_fail(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    (tmp_path / "other").write_text("nothing of use\n" * 9)
    line = '1.2.3.4 - - [01/Mar/2024:10:00:00 +0000] "GET /opinion/%s/ HTTP/1.1" %d 145 "-" "agent"\n'
    (tmp_path / "log").write_text(line % ("old", 500) * 30 + line % ("1 CA-CV 25", 200) * 8 + "noise\n" + line % ("A", 503))
    assert tails.tail(spark, [str(tmp_path / "empty")]).collect() == []
    for name in ("empty", "other"):
        with pytest.raises(ValueError, match="no line reads"):
            L.error_report(spark, [str(tmp_path / name)])
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        L.error_report(spark, [str(tmp_path / "nothing")])
    got = L.error_report(spark, [str(tmp_path / "empty"), str(tmp_path / "log")], lines=10).collect()
    assert [(r["shape"], r.n, r.requests, r.alert) for r in got] == [("/opinion/<X>/", 1, 9, True)]


def test_parse_logs(spark):
    docs = [(1, '{"case_number":"A1","case_name":"","is_precedential":false,"disposition":"Affirmed","author":[]}'), (2, "{no"), (3, None), (4, '{"case_number":["x"],"author":"Lee","release_date":"2020-01-02","is_precedential":true}')]
    logs = G.log_rows(spark.createDataFrame(docs, "opinion_id long, json string").withColumns({"sha": F.lit("s"), "state": F.lit("MN")}), "sha", "state", "v1")
    missing = {r.opinion_id: r.missing_fields for r in logs.select("opinion_id", "missing_fields").collect()}
    assert missing[1] == ["case_name", "release_date", "author"] and missing[2] == missing[3] == list(G.TRACKED) and missing[4] == ["case_name", "disposition"]
    seen = spark.createDataFrame([(1, "MN", "s"), (2, "MN", "other")], "opinion_id long, parser_state string, raw_text_sha256 string")
    assert sorted(r.opinion_id for r in G.fresh_logs(logs, seen).select("opinion_id").collect()) == [2, 3, 4]
    op = spark.createDataFrame([(k, "", None, None, None, "", True) for k in (1, 2, 3, 4, 5)], "id long, case_number string, title string, release_date string, disposition string, disposition_bucket string, is_precedential boolean").withColumn("release_date", F.to_date("release_date"))
    got = {r.id: r for r in G.filled_opinions(op, logs).collect()}
    assert (got[1].case_number, got[1].title, got[1].disposition_bucket, got[1].is_precedential) == ("A1", None, "affirmed", False)
    assert str(got[4].release_date) == "2020-01-02" and got[4].is_precedential and [tuple(got[k])[1:] for k in (2, 3, 5)] == [("", None, None, None, "", True)] * 3
    assert "case_number" in G.schema_of_all(logs).first().shape
