"""Learned partitions: recall against brute force, equal vectors, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from lodestrata.llm import neighbours as N


def brute(rows, k):
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(np.clip(x @ x.T, -1, 1), 9)
    np.fill_diagonal(s, -9)
    ids = [i for i, _ in rows]
    near = {i: [ids[j] for j in np.lexsort((np.arange(len(ids)), -s[n]))[:k]] for n, i in enumerate(ids)}
    return near


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim))
    return sorted((f"id{i:05d}", (centres[rng.integers(30)] + 0.5 * rng.standard_normal(dim)).round(4).tolist()) for i in range(n))


def test_recall_and_routing(spark):
    rows = clustered(3000, 16)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    got = {r.id: [x.id for x in r.near] for r in N.nearest(df, 10, 16, sample=1500, per_partition=100, tile=200).collect()}
    want = brute(rows, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.95


def test_partitions_that_are_cut_again(spark):
    """Partitions stay bounded when the first sample allows few: recall, and sizes of the last level."""
    rows = clustered(4000, 16)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    got = {r.id: [x.id for x in r.near] for r in N.nearest(df, 10, 16, sample=400, per_partition=60, tile=100).collect()}
    want = brute(rows, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.93
    router = N.learn(N._units(df.toPandas().vector)[:400], 4000, per_partition=60)
    first = df.select(F.monotonically_increasing_id().alias("rank"), F.col("vector").alias("v")).selectExpr("rank", "v", "1 as rn", "rank as cls").mapInPandas(N._index(router), "rank long, v array<float>, rn int, cls long, parts array<long>, ps array<double>")
    placed = first.selectExpr("rank", "cls", "v", "parts[0] as part", "ps[0] as p", "true as home", "true as asks")
    sizes = [r["count"] for r in N.refine(placed, 10, 400, 60).where("home").groupBy("part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 240


def test_equal_vectors_ties_and_dirt(spark):
    rng = np.random.default_rng(2)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(f"s{i:03d}", same) for i in range(60)] + [(f"r{i:03d}", rng.standard_normal(4).round(3).tolist()) for i in range(40)] + [("t", [2.0, 4.0, 6.0, 8.0])]
    rows = sorted(rows)
    bad = [("n", None), ("z", [0.0] * 4), ("nan", [1.0, float("nan"), 1.0, 1.0]), ("short", [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame(rows + rows[:30] + bad, "id string, vector array<float>")
    got = {r.id: [x.id for x in r.near] for r in N.nearest(df.withColumn("v", df.id).withColumn("rn", df.id), 3, 4).collect()}
    assert got == brute(rows, 3)
    pairs = [tuple(r) for r in N.pairs(N.nearest(df, 3, 4)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_few_and_none(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<float>")
    assert {r.id: [x.id for x in r.near] for r in N.nearest(df, 10, 2).collect()} == {"a": ["b"], "b": ["a"]}
    assert N.nearest(df.limit(0), 10, 2).count() == 0
    assert N.nearest(df.limit(1), 10, 2).select("near").first()[0] == []


def test_partitions_are_balanced():
    x = np.array([v for _, v in clustered(512, 8)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = N.balanced_partition(N.knn_graph(x, 8), 3, np.random.default_rng(0))
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() - sizes.min() <= 3


def test_blocks_with_one_side_empty(spark):
    rows = clustered(80, 8)
    df = spark.createDataFrame(rows, "id string, vector array<float>")
    got = {r.id: [x.id for x in r.near] for r in N.nearest(df, 5, 8, tile=3).collect()}
    assert got == brute(rows, 5)
