"""Changed content as a table and as a stream: replays and rows out of order give the same."""

import random

import pytest

from lexlake.streaming import changes as C

CONTENT, KEEP, LATE = ("event_type", "props"), 3_600, "2 hours"
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def store(spark):
    old = spark.conf.get(C.STORE[0], None)
    spark.conf.set(*C.STORE)
    yield
    spark.conf.set(C.STORE[0], old) if old else spark.conf.unset(C.STORE[0])


def event(k, minute, user, props):
    return (k, f"2024-03-{1 + minute // 1_440:02d} {minute // 60 % 24:02d}:{minute % 60:02d}:00", user, "edit", 1.0, props)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", C.F.to_timestamp("ts"))


def rows_of(df):
    return sorted((r.key, r.ts.isoformat(), r.id, r.sha256, r.pending) for r in df.collect())


def batch(spark, rows):
    return rows_of(C.content_changes(frame(spark, rows), "user_id", "ts", "event_id", CONTENT, KEEP))


def run(spark, path, name, late=LATE):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    out = C.content_changes_stream(stream, "user_id", "ts", "event_id", CONTENT, KEEP, late)
    query = out.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_changes_of_a_table(spark):
    rows = [event(1, 0, 7, "a"), event(2, 1, 7, "a"), event(3, 2, 7, "b"), event(4, 2, 7, "a"), event(4, 2, 7, "a"), event(5, 90, 7, "a"), event(6, 3, 8, None), event(7, 4, 8, ""), event(8, 5, None, "x")]
    assert [(k, i) for k, _, i, _, _ in batch(spark, rows)] == [("7", 1), ("7", 3), ("7", 4), ("7", 5), ("8", 6), ("8", 7)]


def test_a_stream_out_of_order_and_replayed(spark, tmp_path, store):
    rng, rows, minute = random.Random(5), [], 0
    for k in range(120):
        minute += rng.choice([0, 1, 5, 30])
        rows.append(event(k, minute, rng.randint(1, 3), rng.choice("ab")))
    end = [event(900, minute + 600, 9, "z"), event(901, minute + 601, 9, "z")]
    files = [rows[s : s + 40] for s in range(0, 120, 40)]
    moved = rng.sample(files[0][-8:], 3)  # a few rows come with the next file, and some come twice
    files[0] = [r for r in files[0] if r not in moved]
    files[1] = files[1] + moved + files[0][-5:]
    for n, part in enumerate([*files, end[:1], end[1:]]):
        rng.shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = run(spark, tmp_path, n)  # each run resumes where the last one ended
    want = batch(spark, rows)
    got = rows_of(spark.read.schema(C.OUT).parquet(str(tmp_path / "out")))
    assert got == want and len(want) > 20
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 6, left  # of 120 rows and 3 keys what is left is the last user's


def test_replays_of_a_stream(spark, tmp_path):
    for part in ([event(1, 0, 7, "a"), event(2, 1, 7, "b")], [event(1, 0, 7, "a"), event(3, 9, 7, "b")], [event(2, 1, 7, "b")]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = C.without_replays(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "event_id", LATE)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
