"""Most similar vectors for every vector, by learned partitions.

Index
    On a sample of at most ``SAMPLE`` distinct vectors (the bound is a parameter) the
    driver builds the neighbour graph, cuts it into balanced partitions by
    recursive bisection (a spectral split at the median, then swaps that lower
    the cut), and trains a small classifier on the partitions of each vector's
    neighbours. Every vector of the table is then indexed in its most probable
    partition. A partition that still holds more than ``2 * PER_PARTITION`` vectors draws
    a bounded sample of its own and learns its own cut and classifier, in a task of
    its own; this is repeated until no partition is too large or none can be cut, so partitions grow in number with the
    table and not in size. Nothing but the first sample and its classifier (fixed
    size) passes through the driver.
Search
    Every vector is a query. The classifier routes it to its most probable
    partitions until their probabilities reach ``MASS``, at least ``LEAST`` and at most
    ``MOST`` of them; inside a partition that is cut again, to parts of it until what is left out
    has less than ``REST`` of the query's probability. The partitions are
    reranked by exact cosine in blocks. Partitions that
    hold more than ``TILE`` vectors are split over blocks by a hash, so no task
    holds more than one block of vectors and one of queries; every block is read.

Between stages vectors are known by the rank of their id (a number that keeps the
order of ids, from a range-partitioned sort), and a cosine is a whole number of
10^-9, so a candidate takes 12 bytes.

Equal vectors under several ids form one class, found without collecting it: a
class is searched once, and its ``k + 1`` smallest ids stand for it among the
candidates, which is all that the top k of any vector can need.

Defined edge cases
    null, wrong length, NaN, infinite and all-zero vectors take no part;
    repeated rows count once; of several vectors under one id the smallest
    counts; at equal cosine (to 9 decimals) the smaller id goes first; with
    fewer than k others, all others are neighbours; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut

SAMPLE = 6000
PER_PARTITION = 1200  # vectors of the table per partition, as far as the sample allows
SAMPLE_PER_PARTITION = 60
MASS, LEAST, MOST = 0.995, 3, 14
REST = 0.001  # of a query's probability, left out in a partition that is cut again
TILE = 4096
WAYS = 64  # parts of a partition that is cut again, at most
UNIT = 10**9  # cosines are whole numbers of 1 / UNIT
BLOCK_ROWS = 1 << 20  # rows (part, two numbers) of the table of blocks up to which it is broadcast


# ---- learning, on the bounded sample -------------------------------------------------


def knn_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar rows of ``x`` (unit rows), in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, rng: np.random.Generator, rounds: int = 40, swaps: int = 12) -> np.ndarray:
    """Halves of equal size with few edges between them; edges are given by positions in ``nodes``."""
    n = len(nodes)
    degree = np.bincount(src, minlength=n) + 1e-9
    f = rng.standard_normal(n)
    for _ in range(rounds):  # power iteration on the lazy walk, away from the constant vector
        f = 0.5 * f + 0.5 * np.bincount(src, weights=f[dst], minlength=n) / degree
        f -= np.average(f, weights=degree)
        f /= np.linalg.norm(f) + 1e-12
    side = np.zeros(n, dtype=bool)
    side[np.argsort(f, kind="stable")[n // 2 :]] = True
    for _ in range(swaps):
        across = np.bincount(src, weights=(side[src] != side[dst]), minlength=n)
        gain = 2 * across - degree
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        good = int(np.sum(gain[a[:m]] + gain[b[:m]] > 0)) // 2
        if not good:
            break
        before = side.copy()
        side[a[:good]], side[b[:good]] = False, True
        if np.sum(side[src] != side[dst]) >= np.sum(before[src] != before[dst]):
            side = before
            break
    return side


def balanced_partition(graph: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of ``2 ** depth`` partitions of equal size (to one) of the neighbour graph."""
    n, k = graph.shape
    src = np.repeat(np.arange(n), k)
    dst = graph.ravel()
    src, dst = np.concatenate([src, dst]), np.concatenate([dst, src])
    label = np.zeros(n, dtype=np.int64)
    for _ in range(depth):
        nxt = label * 2
        for part in np.unique(label):
            nodes = np.flatnonzero(label == part)
            if len(nodes) < 2:
                continue
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[src] >= 0) & (place[dst] >= 0)
            nxt[nodes] += _bisect(nodes, place[src[inside]], place[dst[inside]], rng)
        label = nxt
    return label


@dataclass
class Router:
    """One hidden layer and a softmax over partitions."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, hidden: int, rng: np.random.Generator, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Cross entropy against ``target`` (share of each vector's neighbours by partition), Adam."""
    d, p = x.shape[1], target.shape[1]
    params = [rng.standard_normal((d, hidden)) * math.sqrt(2 / d) * 2, np.zeros(hidden), rng.standard_normal((hidden, p)) * math.sqrt(1 / hidden), np.zeros(p)]
    m1, m2, step = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params], 0
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            xb = x[rows] + rng.standard_normal((len(rows), d)) * 0.02
            h = xb @ params[0] + params[1]
            a = np.maximum(h, 0)
            z = a @ params[2] + params[3]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            g = (q / q.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ params[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((xb.T @ gh, gh.sum(0), a.T @ g, g.sum(0))):
                m1[i] = 0.9 * m1[i] + 0.1 * grad
                m2[i] = 0.999 * m2[i] + 0.001 * grad**2
                params[i] = params[i] - lr * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*params)


def learn(sample: np.ndarray, total: int, *, k: int = 10, seed: int = 7, per_partition: int = PER_PARTITION, most: float = math.inf) -> Router | None:
    """Router over balanced partitions of the sample's neighbour graph; None where one partition is enough."""
    wanted = min(total / per_partition, len(sample) / SAMPLE_PER_PARTITION, most)
    depth = max(0, round(math.log2(max(1.0, wanted))))
    if depth == 0:
        return None
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    graph = knn_graph(x, k)
    label = balanced_partition(graph, depth, rng)
    p = 2**depth
    target = np.zeros((len(x), p))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    np.add.at(target, (np.arange(len(x)), label), graph.shape[1] / 2)
    target /= target.sum(axis=1, keepdims=True)
    return train_router(x, target, 128, rng)


def route(p: np.ndarray, mass: float = MASS, least: int = LEAST, most: int = MOST) -> list[np.ndarray]:
    """Partitions of each row of ``p`` in falling probability until ``mass`` is reached."""
    most = min(most, p.shape[1])
    order = np.argsort(-p, axis=1)[:, :most]
    total = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
    n = np.clip(np.sum(total < mass, axis=1) + 1, min(least, most), most)
    return [row[:c] for row, c in zip(order, n)]


# ---- the distributed part ---------------------------------------------------------------


def usable(rows: DataFrame, dim: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``id, v, rank``: one usable vector per id; ``rank`` is in the order of ids."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(~bad & F.exists(v, lambda x: x != 0))
    # ranges of ids serve the grouping and the order alike, in one shuffle
    ranged = fine.select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("v")).repartitionByRange("id")
    return cut(ranged.groupBy("id").agg(F.min("v").alias("v")).sortWithinPartitions("id").withColumn("rank", F.monotonically_increasing_id()))


def _index(router: Router | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if router is None:
                yield pdf.assign(parts=[[0]] * len(pdf), ps=[[1.0]] * len(pdf))
                continue
            p = router.probabilities(_units(pdf.v))
            found = route(p)
            yield pdf.assign(parts=[f.tolist() for f in found], ps=[row[f].tolist() for row, f in zip(p, found)])

    return run


def _units(vectors) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def top_of_block(queries: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, similarity in ``1 / UNIT``) of the k best of each query; at equal similarity the first row of ``base``."""
    k = min(k, len(base))
    parts = []
    for lo in range(0, len(queries), 512):
        s = np.rint(np.clip(queries[lo : lo + 512] @ base.T, -1, 1) * UNIT).astype(np.int32)
        edge = np.partition(s, len(base) - k, axis=1)[:, len(base) - k]
        q, b = np.nonzero(s >= edge[:, None])
        order = np.lexsort((b, -s[q, b], q))
        q, b = q[order], b[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        q, b = q[rank < k], b[rank < k]
        parts.append((q + lo, b, s[q, b]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _rerank(k: int):
    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or base.empty:
            return pd.DataFrame()
        base = base.sort_values("rank", ignore_index=True)
        q, b, s = top_of_block(_units(queries.v), _units(base.v), k)
        ranks, cls = base["rank"].to_numpy(), queries.cls.to_numpy()
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        return pd.DataFrame({"cls": cls[q[starts]], "far": np.split(-s, starts[1:]), "near": np.split(ranks[b], starts[1:])})

    return run


_ROWS = "rank long, cls long, v array<float>, part long, p double, home boolean, asks boolean"


def _learn_part(k: int, per_partition: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        router = learn(_units(pdf.sort_values("rank").v), int(pdf.n.iloc[0]), k=k, per_partition=per_partition, most=WAYS)
        return pd.DataFrame({"part": pdf.part.iloc[:1], "router": [pickle.dumps(router)]})

    return run


def _route_part(rest: float):
    def run(rows: pd.DataFrame, routers: pd.DataFrame) -> pd.DataFrame:
        router = pickle.loads(routers.router.iloc[0]) if len(rows) and len(routers) else None
        if router is None:
            return rows[[c.split()[0] for c in _ROWS.split(", ")]]
        q = router.probabilities(_units(rows.v))
        order = np.argsort(-q, axis=1)
        shares = np.take_along_axis(q, order, axis=1)
        left = rows.p.to_numpy()[:, None] * (1 - np.cumsum(shares, axis=1))
        n = np.where(rows.asks, np.sum(left > rest, axis=1) + 1, 1).clip(1, q.shape[1])
        at = np.repeat(np.arange(len(rows)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        out = rows[["rank", "cls", "v", "asks"]].iloc[at].reset_index(drop=True)
        return out.assign(part=(rows.part.to_numpy()[at] + 1) * 256 + order[at, nth], p=rows.p.to_numpy()[at] * shares[at, nth], home=rows.home.to_numpy()[at] & (nth == 0))[[c.split()[0] for c in _ROWS.split(", ")]]

    return run


def refine(rows: DataFrame, k: int, sample: int, per_partition: int, rest: float = REST) -> DataFrame:
    """Rows (a vector in a partition that holds it or that it asks) with partitions that are too large cut again, level by level."""
    while True:
        sizes = rows.where("home").groupBy("part").agg(F.count("*").alias("n"))
        # every level multiplies the number of partitions; those that cannot be cut (few distinct vectors) keep their size
        large = cut(sizes.where(F.col("n") > 2 * per_partition))
        if large.isEmpty():
            return rows
        drawn = Window.partitionBy("part").orderBy(F.xxhash64("rank"), "rank")
        learnt = rows.where("home and asks").join(large, "part").withColumn("nth", F.row_number().over(drawn)).where(F.col("nth") <= sample)
        routers = cut(learnt.groupBy("part").applyInPandas(_learn_part(k, per_partition), "part long, router binary"))
        # a partition's rows go to their classifier in blocks, so no task holds a whole partition
        spread = large.select("part", F.ceil(F.col("n") / (2 * TILE)).cast("int").alias("blocks"))
        marked = rows.join(spread, "part", "left")
        todo = marked.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("rank"), F.col("blocks")).cast("int"))
        sent = routers.join(spread, "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "block", "router")
        routed = todo.groupBy("part", "block").cogroup(sent.groupBy("part", "block")).applyInPandas(_route_part(rest), _ROWS)
        names = [c.split()[0] for c in _ROWS.split(", ")]
        before, rows = rows, cut(marked.where("blocks is null").select(*names).unionByName(routed.select(*names)))
        if rows.where("home").join(large, "part", "left_semi").count() == rows.where("home").count() or before.select("part").distinct().count() == rows.select("part").distinct().count():
            return rows


def near_ranks(rows: DataFrame, k: int, dim: int, id_col: str, vector_col: str, sample: int, per_partition: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """``id, v, rank`` of all usable vectors, and ``rank, near ARRAY<STRUCT<far, near>>``: their most similar others by rank."""
    every = usable(rows, dim, id_col, vector_col)
    by_vector = Window.partitionBy("v").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    listed = cut(every.select("rank", "v", F.row_number().over(by_vector).alias("rn"), F.first("rank").over(by_vector).alias("cls")).where(F.col("rn") <= k + 1))
    classes = listed.where(F.col("rn") == 1)
    total = classes.count()
    drawn = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("v").toPandas()
    router = learn(_units(drawn.v), total, per_partition=per_partition) if len(drawn) > 1 else None
    indexed = listed.mapInPandas(_index(router), "rank long, v array<float>, rn int, cls long, parts array<long>, ps array<double>")
    probes = F.when(F.col("rn") == 1, F.arrays_zip("parts", "ps")).otherwise(F.slice(F.arrays_zip("parts", "ps"), 1, 1))
    placed = indexed.select("rank", "cls", "v", (F.col("rn") == 1).alias("asks"), F.posexplode(probes).alias("nth", "probe"))
    placed = cut(placed.select("rank", "cls", "v", F.col("probe.parts").alias("part"), F.col("probe.ps").alias("p"), (F.col("nth") == 0).alias("home"), "asks"))
    placed = refine(placed, k, sample, per_partition)

    # blocks of a partition: two numbers each, broadcast up to a counted bound
    counts = placed.groupBy("part").agg(F.sum(F.col("home").cast("long")).alias("held"), F.sum(F.col("asks").cast("long")).alias("asked"))
    blocks = cut(counts.select("part", F.greatest(F.lit(1), F.ceil(F.col("held") / tile)).cast("int").alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("asked") / (2 * tile))).cast("int").alias("waves")))
    blocked = placed.join(F.broadcast(blocks) if blocks.count() <= BLOCK_ROWS else blocks, "part")
    base = blocked.where("home").select(F.col("part").alias("part"), F.pmod(F.xxhash64("rank"), "tiles").cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("waves") - 1)).alias("wave"), "rank", F.col("v").alias("v"))
    asks = blocked.where("asks").select("part", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("cls", F.lit(1)), "waves").cast("int").alias("wave"), "cls", "v")
    block = ["part", "tile", "wave"]
    found = asks.groupBy(*block).cogroup(base.groupBy(*block)).applyInPandas(_rerank(k + 1), "cls long, far array<int>, near array<long>")
    # of each class, k + 1 candidates a block; the k + 1 best hold the top k of every member
    zipped = F.flatten(F.transform(F.collect_list(F.struct("far", "near")), lambda x: F.arrays_zip(x["far"].alias("far"), x["near"].alias("near"))))
    best = found.groupBy("cls").agg(F.slice(F.array_sort(zipped), 1, k + 1).alias("near"))

    small = listed.select("rank", "cls").join(best, "cls").select("rank", "near")
    # members of large classes beyond the listed ones: the class's list is copied to salts, as one class may hold a third of all rows
    salts = 16
    large = listed.where(F.col("rn") == k + 1).select("cls", "v", F.col("rank").alias("last")).join(best, "cls").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = every.withColumn("salt", F.pmod(F.xxhash64("rank"), F.lit(salts)).cast("int")).join(large, ["v", "salt"]).where(F.col("rank") > F.col("last")).select("rank", "near")
    return every, small.unionByName(rest).select("rank", F.slice(F.filter("near", lambda x: x["near"] != F.col("rank")), 1, k).alias("near"))


def nearest(rows: DataFrame, k: int = 10, dim: int = 64, id_col: str = "id", vector_col: str = "vector", sample: int = SAMPLE, per_partition: int = PER_PARTITION, tile: int = TILE) -> DataFrame:
    """``id, near ARRAY<STRUCT<far, id>>``: the k most similar others of every usable vector, ``far`` = -cosine."""
    every, near = near_ranks(rows, k, dim, id_col, vector_col, sample, per_partition, tile)
    names = every.select("rank", "id")
    flat = near.select("rank", F.explode("near").alias("x")).select("rank", (F.col("x.far") / UNIT).alias("far"), F.col("x.near").alias("other"))
    named = flat.join(names.select(F.col("rank").alias("other"), F.col("id").alias("other_id")), "other").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("far", F.col("other_id").alias("id")))).alias("near"))
    return names.join(named, "rank", "left").select("id", F.coalesce("near", F.array().cast("array<struct<far:double,id:string>>")).alias("near"))


def similar_pairs(rows: DataFrame, k: int = 10, dim: int = 64, id_col: str = "id", vector_col: str = "vector", sample: int = SAMPLE, per_partition: int = PER_PARTITION, tile: int = TILE) -> DataFrame:
    """Distinct ``(id_a, id_b)``, ``id_a < id_b``, in which at least one is among the other's nearest."""
    every, near = near_ranks(rows, k, dim, id_col, vector_col, sample, per_partition, tile)
    flat = near.select("rank", F.explode("near.near").alias("other"))
    # ranks are in the order of ids, so pairs are made distinct as numbers and named afterwards
    both = flat.select(F.least("rank", "other").alias("a"), F.greatest("rank", "other").alias("b")).distinct()
    names = every.select("rank", "id")
    named = both.join(names.select(F.col("rank").alias("a"), F.col("id").alias("id_a")), "a").join(names.select(F.col("rank").alias("b"), F.col("id").alias("id_b")), "b")
    return named.select("id_a", "id_b")


def pairs(near: DataFrame) -> DataFrame:
    """``similar_pairs`` of the result of ``nearest``."""
    flat = near.select("id", F.explode("near.id").alias("other"))
    return flat.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
