"""Orphan references: rule, dirt, hot keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.operators import references as R

T0 = datetime(2025, 1, 1)


def at(day):
    return None if day is None else T0 + timedelta(days=day)


def frames(spark, refs, lives):
    r = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(refs)], "rid int, key string, t timestamp_ntz")
    p = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in lives], "id string, first timestamp_ntz, gone timestamp_ntz")
    return r, p


def found(r, p):
    kw = dict(key="key", time="t", parent_key="id", parent_start="first", parent_end="gone")
    return sorted(x.rid for x in R.orphans(r, p, **kw).collect())


def brute(refs, lives):
    alive = lambda k, t: any(x == k and (t is None or ((a is None or a <= t) and (b is None or t < b))) and (b is None or b > (a if a is not None else -9999)) for x, a, b in lives)
    return sorted(i for i, (k, t) in enumerate(refs) if k is not None and k.strip() and not alive(k, t))


def test_random_lives(spark):
    rng = random.Random(2)
    keys = [f"k{i}" for i in range(12)]
    lives = [(rng.choice(keys[:9]), a := rng.choice([None, *range(0, 90, 7)]), rng.choice([None, (a or 0) + rng.randint(-3, 40)])) for _ in range(60)]
    refs = [(rng.choice([*keys, None, "", "  "]), rng.choice([None, *range(-5, 120, 5)])) for _ in range(600)]
    assert found(*frames(spark, refs, lives + lives[:7])) == brute(refs, lives)


def test_bounds_and_empty(spark):
    lives = [("a", 10, 20), ("a", 20, 30), ("b", 5, None)]
    refs = [("a", 9), ("a", 10), ("a", 20), ("a", 30), ("b", 4), ("b", 5), ("c", 1)]
    r, p = frames(spark, refs, lives)
    assert found(r, p) == [0, 3, 4, 6]
    assert found(r, p.limit(0)) == list(range(7)) and found(r.limit(0), p) == []


def test_hot_key_is_salted(spark, monkeypatch):
    lives = [("hot", 3, 50)] + [(f"k{i}", 0, None) for i in range(50)]
    refs = [("hot", t % 60) for t in range(6000)] + [(f"k{i % 60}", 1) for i in range(3000)]
    refs = [(k, t + i / 10000) for i, (k, t) in enumerate(refs)]
    assert found(*frames(spark, refs, lives)) == brute(refs, lives)


def test_clashing_columns_and_repeats(spark):
    r, p = frames(spark, [("x", 1), ("y", 1)], [("y", 0, None)])
    r = r.selectExpr("*", "rid as k", "key as lo", "t as hi", "1 as salt")
    kw = dict(key="key", time="t", parent_key="id", parent_start="first", parent_end="gone")
    out = R.orphans(r.union(r), p.withColumn("k", F.lit("x")), **kw)
    assert [x.key for x in out.collect()] == ["x", "x"] and out.columns == r.columns


def test_paths(spark):
    raw = [" ./a/b.ts", "/a/b.ts#L3-L9", "a\\b.ts:3", "a/b.ts ", "a/b.ts#L3", "A/b.ts", ".//a/b.ts"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "p string").select(R.clean_path(F.col("p"))).collect()]
    assert got == ["a/b.ts"] * 5 + ["A/b.ts", "a/b.ts"]


def test_counts(spark):
    rows = spark.createDataFrame([("t", "f", "1", "k", at(3)), ("t", "f", "1", "k", at(3)), ("t", "f", "2", "k", at(40)), ("t", "f", "3", "m", None)], "ref_table string, ref_field string, ref_id string, ref_key string, at timestamp_ntz")
    got = sorted((r.period or "", r.orphans, r["keys"]) for r in R.count_by_period(rows).collect())
    assert got == [("", 1, 1), ("2025-01-01", 1, 1), ("2025-02-01", 1, 1)]
