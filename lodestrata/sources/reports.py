"""Reports of retrieval metrics as Markdown and JSON lines.

Lines come with the order in which they stand, ``(part, key, line)``, so that a report over any number of
queries is written by as many tasks as it needs. Missing means are ``N/A``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: fixed values: headings of the metrics
MEANS = {"p_5": "Precision@5", "p_10": "Precision@10", "r_5": "Recall@5", "r_10": "Recall@10", "mrr": "MRR", "ndcg": "nDCG@10", "ap": "MAP", "ctx_precision": "Context Precision", "context_recall": "Context Recall"}
PER_QUERY = {"p_5": "P@5", "r_5": "R@5", "mrr": "MRR", "ap": "MAP", "ctx_precision": "Ctx Precision"}


def four(x: Column) -> Column:
    return F.coalesce(F.format_number(x.cast("double"), 4), F.lit("N/A"))


def markdown(metrics: DataFrame, dataset: str, date: str, query: str = "query_id") -> DataFrame:
    """``part, key, line``: heading, means and one row per query of ``metrics``; to be read in the order of ``part`` and ``key``."""
    have = lambda name: c(name) if name in metrics.columns else F.lit(None).cast("double")
    sums = metrics.agg(F.count("*").alias("n"), *(F.avg(have(m)).alias(m) for m in MEANS))
    head = ["# IR Metrics Report", "", f"**Dataset**: {dataset}", f"**Date**: {date}"]
    means = [F.concat(F.lit(f"| {title} | "), four(c(m)), F.lit(" |")) for m, title in MEANS.items()]
    lines = F.array(
        *(F.lit(x) for x in head), F.concat(F.lit("**Queries**: "), c("n").cast("string")), F.lit(""), F.lit("## Aggregate Metrics"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|--------|-------|"), *means,
        F.lit(""), F.lit("## Per-Query Results"), F.lit(""), F.lit("| Query | " + " | ".join(PER_QUERY.values()) + " |"), F.lit("|-------" * (len(PER_QUERY) + 1) + "|"),
    )
    top = sums.select(F.posexplode(lines).alias("part", "line")).select("part", F.lit("").alias("key"), "line")
    name = c(query).cast("string")
    row = F.concat(F.lit("| "), F.regexp_replace(F.coalesce(name, F.lit("")), r"[|\n\r]", " "), F.lit(" | "), F.concat_ws(" | ", *(four(have(m)) for m in PER_QUERY)), F.lit(" |"))
    return top.unionByName(metrics.select(F.lit(1000).alias("part"), F.coalesce(name, F.lit("")).alias("key"), row.alias("line")))


def json_lines(rows: DataFrame) -> DataFrame:
    """``line``: every row as JSON, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))
