import datetime

import pytest
from pyspark.sql import functions as F

from lexlake.functions import scalars as S


def values(spark, f, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("f, cases", [
    (S.canonical_case_number, {"No. A15-1566": "A15-1566", "a230380": "A23-0380", "A15-178": "A15-0178", "cl-123": "cl-123", "CX-84-550": "CX-84-550", "No. a230380": "a230380", "": "", None: "", " Nos. 12-34 ": "12-34"}),
    (S.normalize_docket, {"a250872": "A25-0872", "ADM240001": "ADM24-0001", "foo": "FOO", "c1-84-550": "C1-84-550", None: ""}),
    (S.disposition_bucket, {"Affirmed in part, reversed in part": "mixed", "Vacated and remanded": "vacated", "Reversed and remanded": "reversed", "Stayed": "dismissed", "Exceptions overruled": "other", "": "", None: ""}),
    (S.surname, {"Charles G. Douglas 3": "Douglas", "John T. Broderick Jr": "Broderick", "": "", None: "", "Jr.": ""}),
    (S.appeals_division, {"No. 2 CA-SA 2026-0048": "2", "1CA-CV 9": "1", "2 SA-CA": None, None: None}),
    (S.client_network, {"10.1.2.3, 4.5.6.7": "10.1.2.0/24", "2001:db8:1::5": "2001:db8:1::/48", "999.1.1.1": "-", "x": "-", "": "-", None: "-"}),
    (S.state_of_host, {"mn.site.org:80": "MN", "www.nh.site.org": "NH", "site.org": None, "abc.site.org": None, None: None}),
    (S.slugify, {"Anne K. O'Neil": "anne-k-o-neil", None: ""}),
    (S.quote_path, {"No. 84-102/a": "No.%2084-102/a", "ü~": "%C3%BC~"}),
    (S.unquote, {"No.%2084-102": "No. 84-102", "a+b": "a+b", "%zz": "%zz"}),
    (S.collapse, {" a\n\t b  c ": "a b c", None: ""}),
    (S.title_case, {"MCDONALD v. Smith": "Mcdonald v. Smith"}),
])
def test_strings(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_numbers(spark):
    assert values(spark, S.nice_max, [3, 47, 50, 201, 1000], "long") == [5, 50, 60, 300, 1100]
    assert values(spark, S.tick_step, [5, 6, 16, 41], "int") == [1, 2, 5, 10]
    assert values(spark, S.similarity_percent, [0.125, None, -0.5, 2.0], "double") == [88, 0, 100, 0]
    assert values(spark, lambda c: S.percent(c, F.lit(8)), [1, 0], "int") == [12.5, 0.0]


def test_dates(spark):
    row = spark.range(1).select(S.bluebook(F.lit("State v. Smith"), F.lit("2026 N.H. 7"), F.lit("x"), F.lit("2026-06-11").cast("date")).alias("a"), S.bluebook(F.lit("State v.\n Smith"), F.lit(""), F.lit("2024-0123"), F.lit("2026-06-11").cast("date")).alias("b"),
                                S.parse_date(F.lit("June 1, 2020"), "MMMM d, yyyy", "yyyy-MM-dd").alias("c"), S.decade(F.lit("1999-01-01").cast("date")).alias("d")).first()
    assert row.a == "State v. Smith, 2026 N.H. 7 (June 11, 2026)." and row.b == "State v. Smith, No. 2024-0123 (N.H. June 11, 2026)."
    assert row.c == datetime.date(2020, 6, 1) and row.d == 1990
    assert S.years_cutoff("all", F.lit("2020-01-01")) is None


def test_court_labels(spark):
    rows = [("MN", "SUPREME", "", "x"), ("AZ", "APPEALS", "2", "x"), ("LA", "APPEALS", "1", "x"), ("TX", "APPEALS", "", "Court x")]
    df = spark.createDataFrame(rows, "s string, l string, d string, n string")
    assert [r[0] for r in df.select(S.court_label(F.col("s"), F.col("l"), F.col("d"), F.col("n"))).collect()] == ["Minn.", "Ariz. Ct. App. Div. 2", "La. Ct. App. 1st Cir.", "Court x"]


def test_archive_url(spark):
    df = spark.createDataFrame([("https://x/archive/ctappub/2021/OPa210414-011722.pdf",), ("/a210414.pdf",), ("nothing",)], "u string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in S.archive_url(F.col("u")).items()]).collect()]
    assert got == [("A21-0414", datetime.date(2022, 1, 17), "ctappub"), ("A21-0414", None, None), (None, None, None)]


def test_captions(spark):
    df = spark.createDataFrame([("State v. Smith Jones", "SMITH vs. State"), ("Doe v. Roe", "In re Smith"), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(S.captions_compatible(F.col("a"), F.col("b"))).collect()] == [True, False, True]
