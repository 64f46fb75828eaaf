"""Retrieval metrics over runs and relevance judgements, budget curves, regressions.

``runs(query_id, item_id, rank)`` with ranks from 1, ``qrels(query_id, item_id)``; every
query of ``qrels`` or ``runs`` has a row.

Defined edge cases: k below 1, empty lists and empty relevant sets score 0;
repeated judgements count once; an item retrieved twice counts at each rank;
baselines of 0 change by 0 percent; fewer than two budgets have an area of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def ir_metrics(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (5, 10), ndcg_k: int = 10) -> DataFrame:
    """``query_id, p_k, r_k, mrr, ndcg, ap, ctx_precision`` for each k in ``ks``."""
    rel = qrels.select("query_id", "item_id").distinct()
    sizes = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    flagged = runs.join(rel.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ranked = flagged.withColumn("hits_so_far", F.sum("hit").over(w))
    at = lambda k: F.sum(F.when(c("rank") <= k, c("hit")).otherwise(0))
    sums = ranked.groupBy("query_id").agg(
        *(at(k).alias(f"h_{k}") for k in ks),
        F.min(F.when(c("hit") == 1, c("rank"))).alias("first"),
        F.sum(F.when((c("rank") <= ndcg_k) & (c("hit") == 1), 1 / F.log2(c("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(c("hit") == 1, c("hits_so_far") / c("rank")).otherwise(0.0)).alias("precisions"),
        F.sum("hit").alias("hits"),
    )
    both = sums.join(sizes, "query_id", "full_outer").na.fill(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(c("n_rel"), F.lit(ndcg_k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    return both.select(
        "query_id",
        *((c(f"h_{k}") / k if k > 0 else F.lit(0.0)).cast("double").alias(f"p_{k}") for k in ks),
        *(per(c(f"h_{k}"), c("n_rel")).alias(f"r_{k}") for k in ks),
        F.when(c("first") > 0, 1 / F.when(c("first") > 0, c("first"))).otherwise(0.0).alias("mrr"),
        F.when(c("n_rel") > 0, c("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        per(c("precisions"), c("n_rel")).alias("ap"),
        per(c("precisions"), c("hits")).alias("ctx_precision"),
    )


def context_recall(expected: DataFrame, contexts: DataFrame) -> DataFrame:
    """``query_id, context_recall``: share of ``expected(query_id, text, info)`` whose ``info`` stands in the context ``text``, whatever its case.

    Queries of ``contexts(query_id, ...)`` without expected information have null; a null or empty context has 0.
    """
    found = F.coalesce(F.contains(F.lower("text"), F.lower("info")), F.lit(False)) & (F.coalesce("text", F.lit("")) != "")
    by = expected.where("info is not null").groupBy("query_id").agg(F.avg(F.when(found, 1.0).otherwise(0.0)).alias("context_recall"))
    return contexts.select("query_id").distinct().join(by, "query_id", "left")


def averages(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means of the columns, by group; nulls do not count."""
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(x), 6).alias(x) for x in columns))


def noise_ratio(relevant: Column, total: Column) -> Column:
    """Share of tokens that are not relevant: 0 without tokens, 1 without relevant ones."""
    return F.when(total <= 0, 0.0).when(relevant <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - relevant / F.when(total > 0, total))))


def quality_curve(levels: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``strategy, budget, mrr, share, reached`` from ``levels(strategy, budget, mrr)``: share of the strategy's best, and whether it reaches the threshold."""
    best = F.max("mrr").over(Window.partitionBy("strategy"))
    share = F.when(best > 0, c("mrr") / best).otherwise(0.0)
    return levels.select("strategy", "budget", "mrr", share.alias("share"), (share >= threshold).alias("reached"))


def efficiency(levels: DataFrame, threshold: float = 0.9) -> DataFrame:
    """``strategy, tokens_to_threshold, max_mrr, auc, rank``: by fewest tokens, those that never reach the threshold last, then by best quality."""
    curve = quality_curve(levels, threshold)
    reach = curve.groupBy("strategy").agg(F.min(F.when(c("reached") & (c("mrr") > 0), c("budget"))).alias("tokens_to_threshold"), F.max("mrr").alias("max_mrr"))
    w = Window.orderBy(F.asc_nulls_last("tokens_to_threshold"), F.desc("max_mrr"), "strategy")
    return reach.join(auc(levels), "strategy").withColumn("rank", F.row_number().over(w))


def auc(levels: DataFrame) -> DataFrame:
    """``strategy, auc``: area under quality by budget (trapezoids) over the range of budgets."""
    w = Window.partitionBy("strategy").orderBy("budget")
    steps = levels.withColumn("pb", F.lag("budget").over(w)).withColumn("pm", F.lag("mrr").over(w))
    area = F.sum((c("budget") - c("pb")) * (c("mrr") + c("pm")) / 2)
    span = F.max("budget") - F.min("budget")
    return steps.groupBy("strategy").agg(F.when(span > 0, area / F.when(span > 0, span)).otherwise(0.0).alias("auc"))


def regressions(current: DataFrame, baseline: DataFrame, percent: float = 5.0) -> DataFrame:
    """``metric, baseline, current, delta, delta_percent, regressed`` of two tables ``(metric, value)``."""
    both = baseline.select("metric", c("value").alias("baseline")).join(current.select("metric", c("value").alias("current")), "metric")
    delta = c("current") - c("baseline")
    share = F.when(c("baseline") == 0, 0.0).otherwise(delta / F.when(c("baseline") != 0, c("baseline")) * 100)
    return both.select("metric", "baseline", "current", delta.alias("delta"), share.alias("delta_percent"), (share < -percent).alias("regressed"))
