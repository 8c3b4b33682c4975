"""Aggregates kept up to date: the same as a full run, after any increments and any interruption."""

import random
from collections import Counter

import pytest

from lexlake.operators.views import View, changes, counted


def view_of(spark, path, **options):
    return View(spark, f"file://{path}", "tag STRING, opinion BIGINT", **options)


def change(spark, rows):
    return spark.createDataFrame(rows, "tag string, opinion long, change int")


def state(view):
    return sorted((((r.tag, r.opinion), r.n) for r in view.rows().collect()), key=repr)


def increments(spark, seed, n=6):
    rng, held, out = random.Random(seed), Counter(), []
    for k in range(n):
        rows = [(rng.choice(["a", "b", "c", None]), rng.randint(1, 6), 1) for _ in range(15)]
        for t, o, _ in rows:
            held[t, o] += 1
        gone = rng.sample(sorted(held.elements(), key=repr), 5)
        for key in gone:
            held[key] -= 1
        rows += [(t, o, -1) for t, o in gone]
        out.append((k * 10, lambda rows=rows: change(spark, rows)))
    return out, sorted(((k, n) for k, n in held.items() if n), key=repr)


@pytest.mark.parametrize("seed, buckets", [(1, 8), (2, 1)])
def test_increments_equal_a_full_run(spark, tmp_path, seed, buckets):
    steps, want = increments(spark, seed)
    view = view_of(spark, tmp_path / "v", buckets=buckets)
    assert view.run(steps) and sorted(state(view), key=repr) == want
    assert view.run(steps) and sorted(state(view), key=repr) == want  # nothing is taken in twice
    got = {r.tag: (r.n, r.opinions, r.first) for r in counted(view.rows(), ("tag",), distinct={"opinions": "opinion"}, least={"first": "opinion"}).collect()}
    for tag in got:
        own = [(o, n) for (t, o), n in want if t == tag]
        assert got[tag] == (sum(n for _, n in own), len(own), min(o for o, _ in own))


def test_a_run_that_is_killed_between_two_writes(spark, tmp_path, monkeypatch):
    steps, want = increments(spark, 3, 3)
    view, point, left = view_of(spark, tmp_path / "v", buckets=4), View.point, [1, 0, 1, 0, 0]

    def killed(self, to):
        if left.pop(0):
            raise KeyboardInterrupt  # data are written, the pointer is not
        point(self, to)

    monkeypatch.setattr(View, "point", killed)
    for _ in range(3):
        try:
            assert view.run(steps)
        except KeyboardInterrupt:
            pass
    assert sorted(state(view), key=repr) == want and view.version().number == 3
    folders = len(list((tmp_path / "v" / "data").iterdir()))
    view.vacuum(keep=1)
    assert len(list((tmp_path / "v" / "data").iterdir())) < folders == 5 and view.numbers() == [3] and sorted(state(view), key=repr) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    view = view_of(spark, tmp_path / "v", buckets=64)
    first = view.apply(change(spark, [(f"t{k}", k, 1) for k in range(40)]), 1)
    second = view.apply(change(spark, [("t3", 99, 1), ("t4", 4, -1)]), 2)
    assert sum(first.folders.get(b) != f for b, f in second.folders.items()) <= 2
    assert dict(state(view))["t3", 99] == 1 and ("t4", 4) not in dict(state(view))
    assert view.version(1) == first  # readers of the old version still have it


def test_time_budget(spark, tmp_path):
    steps, want = increments(spark, 4, 4)
    view, ticks, runs = view_of(spark, tmp_path / "v", buckets=2), iter(range(100)), 1
    while not view.run(steps, seconds=1, clock=lambda: next(ticks)):
        runs += 1
    assert runs > 1 and sorted(state(view), key=repr) == want


def test_what_cannot_be(spark, tmp_path):
    view = view_of(spark, tmp_path / "v", buckets=2)
    assert view.rows().collect() == [] and view.version().number == 0
    view.apply(change(spark, [("a", 1, 1)]), 1)
    with pytest.raises(Exception, match="never came"):
        view.apply(change(spark, [("a", 1, -2)]), 2)
    with pytest.raises(RuntimeError, match="another writer"):
        view.point(view.version())
    assert state(view) == [(("a", 1), 1)]
    view.apply(change(spark, [("a", 1, -1)]), 2)
    view.apply(change(spark, []), 3)
    assert view.rows().collect() == [] and view.version().cursor == 3


def test_changes_of_tables(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, v int")
    got = {(r.k, r.v): r.change for r in changes(t([("a", 1), ("a", 1), ("b", 2), (None, 1)]), t([("a", 1), ("b", 3), (None, 1)])).collect()}
    assert got == {("a", 1): -1, ("b", 2): -1, ("b", 3): 1}


def test_a_stream_of_files(spark, tmp_path):
    rows = [(f"t{k % 3}", k, 1) for k in range(30)]
    view = view_of(spark, tmp_path / "v", buckets=4)
    for k in range(3):
        change(spark, rows[k * 10 : (k + 1) * 10]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("tag string, opinion long, change int").parquet(str(tmp_path / "in"))
        view.follow(stream, lambda batch: batch, str(tmp_path / "checkpoint")).awaitTermination()
    assert state(view) == sorted((((t, o), 1) for t, o, _ in rows), key=repr)
