"""Streams equal batches; the limiter's state."""

from datetime import datetime, timedelta

import pytest

from lodestrata.streaming import limiter, pipelines, windows

T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "t")
    rows = [(i, i % 3, ["a", "b"][i % 2], float(i), T0 + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 3, 4, 60, 61, 62, 200, 86400, 86401, 90000])]
    spark.createDataFrame(rows, "event_id int, user_id int, kind string, value double, ts timestamp_ntz").repartition(3).write.parquet(path)
    return path


def collected(spark, stream, tmp_path, mode):
    got = {}
    q = pipelines.run_available(stream, lambda batch, n: got.update({n: [tuple(r) for r in batch.collect()]}), str(tmp_path / "cp"), mode)
    q.awaitTermination(120)
    return sorted(got[max(got)]) if mode == "complete" else sorted(r for rows in got.values() for r in rows)


@pytest.mark.parametrize("make", [lambda e: windows.tumbling(e, ["kind"], "value"), lambda e: windows.sliding(e, ["kind"], "value", size="2 days"), lambda e: windows.sessions(e, "user_id", "kind", gap="10 seconds")], ids=["tumbling", "sliding", "sessions"])
def test_stream_equals_batch(spark, folder, tmp_path, make):
    batch = spark.read.parquet(folder)
    stream = pipelines.read_folder(spark, folder, batch.schema)
    assert collected(spark, make(stream), tmp_path, "complete") == sorted(tuple(r) for r in make(batch).collect())


def test_sessions_split_at_the_gap(spark):
    rows = [(1, "a", T0), (1, "b", T0 + timedelta(seconds=1)), (1, "c", T0 + timedelta(seconds=3, milliseconds=1)), (1, "x", None)]
    got = windows.sessions(spark.createDataFrame(rows, "k int, item string, ts timestamp_ntz"), "k", "item").collect()
    assert sorted((r.n, r["items"]) for r in got) == [(1, "c"), (2, "a,b")]


def test_bucket():
    b = limiter.Bucket(2, 10)
    assert [b.take(t)[0] for t in (0, 0, 0, 4.9, 5, 5.1)] == [True, True, False, False, True, False]
    assert b.take(5.1)[1] == pytest.approx(4.9)


def test_limit_batch_and_stream(spark, folder, tmp_path):
    batch = spark.read.parquet(folder)
    got = sorted(tuple(r) for r in limiter.limit(batch, "user_id", "ts", "event_id", 1, 60).collect())
    assert sum(r[2] for r in got) < len(got) == 12
    one_file = str(tmp_path / "one")
    batch.coalesce(1).write.parquet(one_file)
    stream = limiter.limit_stream(pipelines.read_folder(spark, one_file, batch.schema), "user_id", "ts", "event_id", 1, 60)
    assert collected(spark, stream, tmp_path, "append") == got


def test_append_batches_is_idempotent(spark, tmp_path):
    write = pipelines.append_batches(str(tmp_path / "out"))
    rows = spark.range(3)
    write(rows, 0)
    write(rows, 0)
    write(rows, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
