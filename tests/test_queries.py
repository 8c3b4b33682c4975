"""Each registered query against its SQL."""

import datetime
import math

import duckdb
import pandas as pd
import pytest

from lexlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, datetime.datetime):
        return x.isoformat()[:19].replace("T00:00:00", "")
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, float) and x.is_integer():
        return int(x)
    return x.item() if hasattr(x, "item") else x


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf, name):
    got = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert rows(got.toPandas()) == rows(duck.execute(registry.ORACLES[name]).df())
    else:
        assert got.count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    registry.QUERIES["judge_disagreements"](spark, sf).explain("formatted")
    text = capsys.readouterr().out
    assert "PushedFilters" in text and "ReadSchema" in text and "l_extendedprice" not in text


def test_every_opinion_and_order_is_asked(spark, sf):
    dockets = registry.role(spark, sf, "opinion").select("id")
    got = registry.QUERIES["docket_lookup_all"](spark, sf)
    assert got.count() == got.select("request_id").distinct().count() and got.where("request_id % 17 <> 0").count() > 10 * got.where("request_id % 17 = 0").count()
    assert got.join(dockets, got.request_id == dockets.id, "left_anti").isEmpty()
    assert registry.QUERIES["url_parse_manifest"](spark, sf).count() == registry.role(spark, sf, "orders").count()
