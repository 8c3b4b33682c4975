import hashlib
import html
import json
import random
import re
from collections import Counter

import pyarrow.fs as pafs
import pytest

from lexlake.llm import html_text, warc
from lexlake.llm.common import fresh_dir

ARTICLE = "The court of the state was asked to hold that the rule is not in the code, and that it has to be read with the others."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy the things that you want and need now.</div>
<article><h1>Caf&eacute; &amp; law</h1><p>{ARTICLE}<br>More   of\n it.<p>Short.</p><ul><li>One</li><li>Two</li></ul><div class="comments"><p>{ARTICLE} I think that this is a comment.</p></div><form><p>Sign up to the list.</p></form></article>
<aside>Other news of the day that is to be read</aside><div id="sidebar">of the and to</div><footer>&copy; the owner of the site</footer></body></html>"""
SCHEMA = "page_id long, url string, html string, text string, record_type int"


def test_main_text():
    assert html_text.main_text(PAGE) == f"Café & law {ARTICLE} More of it. Short. One Two"
    assert html_text.main_text(None) == html_text.main_text("") == ""


def test_without_an_article_the_neighbours_decide():
    page = f"<body><div><a href='/'>Home</a> <a href='/x'>News of the day</a></div><p>{ARTICLE}</p><p>{ARTICLE} {ARTICLE}</p><p>So it is.</p><p>{ARTICLE} {ARTICLE}</p><div><a href='/y'>Next of the pages to read</a></div></body>"
    text = html_text.main_text(page)
    assert text.startswith(ARTICLE) and "So it is." in text and "Home" not in text and "Next" not in text


RUSSIAN = "Суд рассмотрел жалобу, поданную заявителем в прошлом году, и решил, что доводы сторон нуждаются в проверке. Решение вступит в силу после публикации."
CHINESE = "法院认为，申请人在去年提出的请求需要重新审查，因此本案发回下级法院。判决自公布之日起生效，双方可以在规定的期限内提出上诉，逾期不再受理。"
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
#: (page, its main text by hand)
LABELLED = [
    (f"<body>{NAV}<div class='text'><p>{RUSSIAN} {RUSSIAN}</p><p>{RUSSIAN}</p></div><div><a href='/a'>Контакты</a> <a href='/b'>О нас</a></div></body>", f"{RUSSIAN} {RUSSIAN} {RUSSIAN}"),
    (f"<body>{NAV}<div><p>{CHINESE}{CHINESE}</p><p>{CHINESE}</p></div><div><a href='/a'>关于我们</a></div></body>", f"{CHINESE}{CHINESE} {CHINESE}"),
    (f"<body>{NAV}<article><a href='/t'>Teaser</a></article><div><p>{ARTICLE} {ARTICLE}</p><p>{ARTICLE} {ARTICLE}</p></div></body>", f"{ARTICLE} {ARTICLE} {ARTICLE} {ARTICLE}"),
    (f"<body>{NAV}<article><p>{ARTICLE} {ARTICLE}</p><section class='discussion'><p>{ARTICLE} I do not agree with any of it.</p></section></article></body>", f"{ARTICLE} {ARTICLE}"),
    (f"<body>{NAV}<article><p>{ARTICLE} {ARTICLE}</p><div class='social-security'><p>{ARTICLE} It is a right.</p></div><div class='social-share'>Tell all of your friends</div></article></body>", f"{ARTICLE} {ARTICLE} {ARTICLE} It is a right."),
    (f"<body>{NAV}<article><p>{ARTICLE} {ARTICLE}</p><p><a href='/x'>{ARTICLE}</a></p><ul><li><a href='/r'>Read of the next one and the others in the list of this week now</a></li></ul><p>{ARTICLE} {ARTICLE}</p></article></body>", f"{ARTICLE} {ARTICLE} {ARTICLE} {ARTICLE} {ARTICLE}"),
    (f"<body>{NAV}<main><h1>The rule</h1><p>{ARTICLE}</p><div id='commentList'><p>{ARTICLE} First!</p></div></main><div class='cookie-notice'>We use them to make it better for you.</div></body>", f"The rule {ARTICLE}"),
    (f"<body>{NAV}<div class='post'><h2>A heading</h2><p>{ARTICLE} {ARTICLE}</p><p>So it is.</p><p>{ARTICLE} {ARTICLE}</p></div><aside><p>{ARTICLE}</p></aside><footer><p>{ARTICLE}</p></footer></body>", f"A heading {ARTICLE} {ARTICLE} So it is. {ARTICLE} {ARTICLE}"),
]


def test_labelled_pages_precision_and_recall():
    right = found = wanted = 0
    for page, text in LABELLED:
        got, want = Counter(re.findall(r"\w", html_text.main_text(page))), Counter(re.findall(r"\w", text))
        right, found, wanted = right + (got & want).total(), found + got.total(), wanted + want.total()
    assert right >= 0.98 * found and right >= 0.98 * wanted


@pytest.mark.parametrize("k", range(len(LABELLED)))
def test_labelled_page(k):
    assert html_text.main_text(LABELLED[k][0]) == LABELLED[k][1]


def test_all_pages_of_the_table_keep_their_paragraphs(spark, sf):
    """The articles of the test table, by a reader of their one form of page: what stands between <article> tags, without markup."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    squeezed = lambda t: re.sub(r"\s+", "", t)
    seen = 0
    for r in rows:
        m = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        if m and not re.search(r"<(form|aside|div|section|footer|header|nav|script|style|!--)", m[1]):
            seen += 1
            assert squeezed(got[r.page_id]) == squeezed(html.unescape(re.sub(r"<[^>]*>", " ", m[1])))
    assert seen >= 10


@pytest.mark.parametrize("page", ["<", "<p", "<!-- x", "<p class='a", "</p></div>", "<script>", "a < b & c &bogus; &#0; &#x110000;", "<b>" * 5_000 + "x", "<p>" + "word " * 200_000, "<a href=x>" * 3_000])
def test_odd_markup(page):
    assert isinstance(html_text.main_text(page), str)


def table(spark):
    big = "x" * 500
    rows = [(1, "u1", PAGE, "", 0), (2, "u2", big, "", 0), (3, "u3", big, "", 0), (4, None, None, "", 0), (5, "u5", "short", "", 0), (6, "u6", "short", "", 0), (None, "u7", big, "", 0), (2, "u2", big, "", 0), (9, "ü 9\n", PAGE, "", 0)] + [(100 + i, "c", "y" * 300, "", 0) for i in range(50)]
    return spark.createDataFrame(rows, SCHEMA)


def test_extract(spark):
    rows = html_text.extract(table(spark)).collect()
    assert len(rows) == 59 and all(r.n_chars == len(r.text) for r in rows) and {r.text for r in rows if r.page_id == 4} == {""}
    assert html_text.extract(table(spark).limit(0)).collect() == []


def test_warc_round_trip(spark):
    df = table(spark)
    rows = warc.archive(df, shard_bytes=4_000, file_bytes=400).collect()
    assert len(rows) == df.count()
    payload = {x.page_id: (x.html or "").encode() for x in df.collect()}
    for r in rows:
        own = payload[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(own), hashlib.sha256(own).hexdigest())
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows)
    assert [k for k in kinds if k[0] in list("123456")] == [("1", "response", None), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 2), ("4", "response", None), ("5", "response", None), ("6", "response", None)]
    assert ("9", "revisit", 1) in kinds and ("None", "response", None) in kinds
    assert sum(k[1] == "revisit" and k[2] == 100 for k in kinds) == 49
    assert warc.archive(df.limit(0)).collect() == []


def test_warc_is_deterministic(spark):
    df, sums = table(spark), []
    for parts in (1, 7):
        out = fresh_dir(spark, "warc")
        warc.write_warc(df.repartition(parts), out, shard_bytes=4_000, file_bytes=400)
        fs, path = pafs.FileSystem.from_uri(out)
        lines = [json.loads(r.value) for r in spark.read.text(f"{out}/manifest").collect()]
        lines.sort(key=lambda x: (x["shard"], x["seq"]))
        names = {f.base_name for f in fs.get_file_info(pafs.FileSelector(path))}
        assert names == {x["file"].rpartition("/")[2] for x in lines} | {"manifest"} and len(lines) > 3
        sums.append([(x["file"].rpartition("/")[2], x["sha256"]) for x in lines])
    assert sums[0] == sums[1]


def test_roles_equal_brute_force(spark):
    rng = random.Random(3)
    payloads = ["p" * 99, "q" * 100, *(rng.choice("rstu") * rng.randrange(90, 140) for _ in range(12)), "", None]
    rows = [(rng.choice([rng.randrange(40), rng.randrange(10**15), None]), f"u{rng.randrange(5)}", rng.choice(payloads), "", 0) for _ in range(400)]
    got = sorted(((r.page_id, r.url, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(spark.createDataFrame(rows, SCHEMA), shard_bytes=5_000, file_bytes=1_000).collect()), key=str)
    want, first, answered = [], {}, set()
    for i, _, h, *_ in rows:
        if i is not None and len(h or "") >= 100:
            first[h] = min(first.get(h, i), i)
    for i, u, h, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        raw = (h or "").encode()
        revisit = h in first and i is not None and (i > first[h] or (i, h) in answered)
        answered.add((i, h))
        want.append((i, u, hashlib.sha256(raw).hexdigest(), len(raw), "revisit" if revisit else "response", first[h] if revisit else None))
    assert got == sorted(want, key=str)


def test_shards_are_even_whatever_the_ids(spark):
    rng = random.Random(1)
    rows = [(10**15, "far", "f" * 300, "", 0)] + [(i, "u", str(rng.random()) * 15, "", 0) for i in range(1_500)] + [(7_777, "hot", str(rng.random()) * 15, "", 0) for _ in range(700)] + [(None, "null", str(rng.random()) * 15, "", 0) for _ in range(700)]
    out = fresh_dir(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame(rows, SCHEMA), out, shard_bytes=100_000, file_bytes=10**9).collect()
    sizes = [r.n_records for r in manifest]
    assert sum(sizes) == len(rows) and len(sizes) >= 15 and max(sizes) <= 1.2 * sum(sizes) / len(sizes)


def test_headers(spark):
    out = fresh_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "http://a", "z" * 200, "", 0), (2, "http://b", "z" * 200, "", 0)], SCHEMA), out)
    fs, path = pafs.FileSystem.from_uri(out)
    with fs.open_input_stream(f"{path}/shard-000000-0000.warc.gz", compression=None) as f:
        info, response, revisit = (raw.partition(b"\r\n\r\n")[0].decode() for _, raw in warc.members(f))
    assert "WARC-Type: warcinfo" in info and "WARC-Filename: shard-000000-0000.warc.gz" in info
    own = next(x for x in response.split("\r\n") if x.startswith("WARC-Record-ID"))
    assert "WARC-Refers-To: " + own.removeprefix("WARC-Record-ID: ") in revisit and "WARC-Refers-To-Target-URI: http://a" in revisit
