"""Exact vector top-k, rank fusion, hybrid search and re-ranking.

Queries are a DataFrame too. Vectors are compared in blocks: rows are spread
over tiles, a tile of queries meets a tile of rows in one task as a matrix
product, and only the k best of each pair of tiles move on; no pair of rows is
ever written out. Filters belong before ranking: pass filtered rows.

Defined edge cases: null vectors, and vectors of another length than the
queries', are left out; zero norms have cosine 0; ties go to the smaller id; ``k``
below 1 gives no rows; ``k`` above the number of rows gives all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TILE = 4096
RRF = 60


def _similarity(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        nq, nx = np.linalg.norm(q, axis=1, keepdims=True), np.linalg.norm(x, axis=1, keepdims=True)
        return np.clip((q / np.where(nq == 0, 1, nq)) @ (x / np.where(nx == 0, 1, nx)).T, -1, 1)
    d2 = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
    exact = np.sqrt(np.maximum(d2, 0))
    for i in range(len(q)):  # cancellation near 0: take those differences directly
        near = np.flatnonzero(d2[i] < 1e-6)
        exact[i, near] = np.linalg.norm(x[near] - q[i], axis=1)
    return 1 / (1 + exact)


def _block(k: int, metric: str, exclude_self: bool):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame()
        rows = rows.sort_values("doc_id", ignore_index=True)
        x = np.stack(rows.v.to_numpy()).astype(np.float64)
        ids, qids = rows.doc_id.to_numpy(), queries.query_id.to_numpy()
        out = []
        for lo in range(0, len(queries), 512):
            s = np.round(_similarity(np.stack(queries.v.to_numpy()[lo : lo + 512]).astype(np.float64), x, metric), 6)
            if exclude_self:
                s[qids[lo : lo + 512, None] == ids[None, :]] = -np.inf
            n = min(k, s.shape[1])
            edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
            a, b = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
            order = np.lexsort((b, -s[a, b], a))
            a, b = a[order], b[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a, side="left") < n
            a, b = a[keep], b[keep]
            out.append(pd.DataFrame({"query_id": qids[lo + a], "doc_id": ids[b], "score": s[a, b]}))
        return pd.concat(out)

    return run


def vector_topk(queries: DataFrame, rows: DataFrame, k: int = 10, metric: str = "cosine", *, tiles: int | None = None, exclude_self: bool = False) -> DataFrame:
    """``query_id, doc_id, score, rank`` from ``queries(query_id, v)`` and ``rows(doc_id, v)``.

    ``metric``: ``cosine``, or ``l2`` with score ``1 / (1 + distance)``. The number of tiles
    follows the number of rows unless it is given.
    """
    if k < 1:
        return top_empty(queries, rows)
    rows = rows.where(F.col("v").isNotNull())
    queries = queries.where(F.col("v").isNotNull())
    n = tiles or max(1, -(-rows.count() // TILE))
    m = max(1, -(-queries.count() // TILE))
    r = rows.select("doc_id", "v", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("tile"), F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("wave"))
    q = queries.select("query_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"), F.size("v").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("wave"))
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["doc_id"]
    by = ["tile", "dim", "wave"]
    found = q.groupBy(*by).cogroup(r.groupBy(*by)).applyInPandas(_block(k, metric, exclude_self), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return ranked(found, k)


def top_empty(queries: DataFrame, rows: DataFrame) -> DataFrame:
    kinds = dict(queries.dtypes)["query_id"], dict(rows.dtypes)["doc_id"]
    return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(vector: DataFrame, lexical: DataFrame, k: int = 10, *, vector_weight: float = 0.7, lexical_weight: float = 0.3, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``(query_id, doc_id, rank)``.

    ``query_id, doc_id, v_rank, b_rank, score, rank``; a list that lacks a document
    adds nothing; ties: better vector rank, then better lexical rank, then smaller id.
    """
    v = vector.select("query_id", "doc_id", F.col("rank").alias("v_rank"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("b_rank"))
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (constant + F.col(rank)), F.lit(0.0))
    both = v.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round(part(vector_weight, "v_rank") + part(lexical_weight, "b_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank"), "doc_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(results: DataFrame, model_score: str = "model_score", top_n: int = 10) -> DataFrame:
    """``new_rank``: the first ``top_n`` results by model score (ties keep their order), the others as they were."""
    first = F.col("rank") <= top_n
    w = Window.partitionBy("query_id").orderBy(F.when(first, 0).otherwise(1), F.desc(F.when(first, F.col(model_score))), "rank")
    return results.withColumn("new_rank", F.row_number().over(w))
