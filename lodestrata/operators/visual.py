"""Preparation of pictures: normalising, fuzzy neighbour graphs, layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; 0.5 where all values are equal. The extremes are one aggregate, not a window over all rows."""
    ends = rows.agg(F.struct(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns)).alias("e")).scalar()
    scaled = {c: F.when(ends[c]["lo"] == ends[c]["hi"], 0.5).otherwise(F.try_divide(F.col(c) - ends[c]["lo"], ends[c]["hi"] - ends[c]["lo"])) for c in columns}
    return rows.withColumns(scaled)


def _sigma(distances: np.ndarray) -> float:
    """Scale at which the summed closeness of k neighbours reaches ``k * 2`` in logs, by bisection."""
    target = np.log(len(distances)) + np.log(2)
    lo, hi = 1e-6, 1e3
    for _ in range(64):
        mid = (lo + hi) / 2
        if np.log(np.sum(np.exp(-distances / mid)) + 1e-300) > target:
            hi = mid
        else:
            lo = mid
    return (lo + hi) / 2


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """``a, b, weight`` (a < b) from ``id, neighbour, distance``: closeness ``p = exp(-d / sigma)``, joined as ``p + q - p q``.

    A neighbour list has a fixed length, so a group is small.
    """
    kind = dict(neighbours.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sigma = [_sigma(np.asarray(d, dtype=float)) for d in pdf.ds]
            yield pdf[["id", "ns", "ds"]].assign(sigma=sigma)

    lists = neighbours.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("l")).select("id", F.col("l.neighbour").alias("ns"), F.col("l.distance").alias("ds"))
    scaled = lists.mapInPandas(run, f"id {kind}, ns array<{kind}>, ds array<double>, sigma double")
    p = scaled.select("id", "sigma", F.explode(F.arrays_zip("ns", "ds")).alias("n")).select(F.least("id", "n.ns").alias("a"), F.greatest("id", "n.ns").alias("b"), F.exp(-F.col("n.ds") / F.col("sigma")).alias("p"))
    # at most the two directions of a pair meet in a group
    return p.groupBy("a", "b").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("p")))))).alias("weight"))


def layout(weights: DataFrame, epochs: int = 200, negatives: int = 5, seed: int = 7, limit: int = 2_000_000) -> DataFrame:
    """``id, x, y``: stochastic layout of a picture's graph, in one task.

    The updates depend on their order, so they do not spread; pictures are bounded, and
    more than ``limit`` edges raise an error instead of being cut.
    """
    kind = dict(weights.dtypes)["a"]
    if weights.count() > limit:
        raise ValueError(f"a picture of more than {limit} edges; reduce the graph first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"], ignore_index=True)
        ids, inverse = np.unique(np.concatenate([pdf.a.to_numpy(), pdf.b.to_numpy()]), return_inverse=True)
        a, b, w = inverse[: len(pdf)], inverse[len(pdf) :], pdf.weight.to_numpy()
        rng = np.random.default_rng(seed)
        x = rng.uniform(-10, 10, (len(ids), 2))
        for epoch in range(epochs):
            rate = 1 - epoch / epochs
            on = rng.random(len(w)) < w / w.max()
            i, j = a[on], b[on]
            d = x[i] - x[j]
            pull = np.clip(-2 * d / (1 + (d * d).sum(1, keepdims=True)), -4, 4) * rate
            np.add.at(x, i, pull)
            np.add.at(x, j, -pull)
            for _ in range(negatives):
                r = rng.integers(0, len(ids), len(i))
                d = x[i] - x[r]
                s = (d * d).sum(1, keepdims=True)
                np.add.at(x, i, np.clip(2 * d / ((0.001 + s) * (1 + s)), -4, 4) * rate)
        return pd.DataFrame({"id": ids, "x": x[:, 0], "y": x[:, 1]})

    return weights.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, f"id {kind}, x double, y double")
