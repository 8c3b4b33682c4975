"""Large dumps in splits, against the reader of whole files."""

import bz2
import random

import pytest

from lexlake.sources import files as X

SCHEMA = "id STRING, a STRING, b STRING"


def quoted(text):
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dump(rows, end="\n"):
    return end.join(["id,a,b", *(",".join([str(i), quoted(a), quoted(b)]) for i, a, b in rows)]) + end


def random_rows(seed, n=400):
    rng = random.Random(seed)
    field = lambda: "".join(rng.choice(['x', "yz", '"', '"', "\\", "\n", ",", " ", "é", '\\"', "|", "\n\n"]) for _ in range(rng.randint(1, 25))) + "."
    return [(i, field(), field()) for i in range(n)]


def read(df):
    return sorted((r.id, r.a, r.b) for r in X.valid(df).collect())


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_records_equal_whole_files(spark, tmp_path, small_splits, seed):
    rows = random_rows(seed)
    (tmp_path / "one.csv").write_text(dump(rows))
    assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 5
    want = sorted((str(i), a, b) for i, a, b in rows)
    assert read(X.split_csv(spark, str(tmp_path / "one.csv"), SCHEMA)) == want == read(X.bulk_csv(spark, str(tmp_path / "one.csv"), SCHEMA))


def test_odd_escaped_quotes(spark, tmp_path):
    text = 'id,a,b\n1,"six\\" pipe","x"\n2,"plain","two\nlines \\" of it"\n3,"back \\\\","y"\n4,"\\\\\\"","z"\n5,"a","b"\n'
    (tmp_path / "q.csv").write_text(text)
    got = read(X.split_csv(spark, str(tmp_path / "q.csv"), SCHEMA))
    assert got == [("1", 'six" pipe', "x"), ("2", "plain", 'two\nlines " of it'), ("3", "back \\", "y"), ("4", '\\"', "z"), ("5", "a", "b")] == read(X.bulk_csv(spark, str(tmp_path / "q.csv"), SCHEMA))


def test_several_files_and_packed_ones(spark, tmp_path, small_splits):
    """Each file has its own header and its own open quotes; one file ends inside a quotation."""
    parts = [random_rows(k, 60) for k in range(4)]
    for k, rows in enumerate(parts):
        text = dump([(f"{k}-{i}", a, b) for i, a, b in rows]).encode()
        (tmp_path / (f"f{k}.csv.bz2" if k % 2 else f"f{k}.csv")).write_bytes(bz2.compress(text) if k % 2 else text)
    (tmp_path / "f9.csv").write_text('id,a,b\n9,"never closed\n')
    got = read(X.split_csv(spark, str(tmp_path), SCHEMA).where("id <> '9' OR id IS NULL"))
    assert got == sorted((f"{k}-{i}", a, b) for k, rows in enumerate(parts) for i, a, b in rows)


def test_carriage_returns(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(dump([(1, "a\r\nb", "c"), (2, "d", "e")], "\r\n").encode())
    assert [(i, a.replace("\r", ""), b) for i, a, b in read(X.split_csv(spark, str(tmp_path / "r.csv"), SCHEMA))] == [("1", "a\nb", "c"), ("2", "d", "e")]


def test_rows_that_do_not_read_are_counted(spark, tmp_path):
    (tmp_path / "n.csv").write_text('id,a,b\n1,"x","y"\nno,"x","y"\n3,"x","y","too many"\n')
    df = X.split_csv(spark, str(tmp_path / "n.csv"), SCHEMA.replace("id STRING", "id INT"))
    assert tuple(X.rejected(df).first()) == (2, 3) == tuple(X.rejected(X.bulk_csv(spark, str(tmp_path / "n.csv"), SCHEMA.replace("id STRING", "id INT"))).first())
