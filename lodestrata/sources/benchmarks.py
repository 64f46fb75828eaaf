"""Benchmark corpora as JSON lines: code search entries and repository tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
CSN = "repo string, path string, func_name string, code string, docstring string, language string, sha string, url string, partition string, code_tokens array<string>, docstring_tokens array<string>"
REPOBENCH = "repo_name string, file_path string, context string, import_statement string, gold_snippet_code string, cross_file_context array<struct<file_path string, code string>>"


def csn_entries(lines: DataFrame, partition: str | None = None, least_tokens: int = 3) -> DataFrame:
    """``entry_id`` and columns of lines ``value`` that parse, name language, repository, path and function, and have a docstring of at least ``least_tokens`` tokens."""
    rows = lines.select(F.from_json("value", CSN).alias("e")).select("e.*").where("language is not null and repo is not null and path is not null and func_name is not null")
    if partition is not None:
        rows = rows.where(c("partition") == partition)
    tokens = F.coalesce("docstring_tokens", F.filter(F.split("docstring", r"\s+"), lambda w: w != ""))
    return rows.withColumn("tokens", tokens).where(F.size("tokens") >= least_tokens).withColumn("entry_id", F.concat_ws(":", "language", "repo", "path", "func_name"))


def repobench_entries(lines: DataFrame) -> DataFrame:
    """Tasks of lines ``value``: ``task_id, query, gold`` and one row per snippet ``(pos, file_path, code)``; lines that do not parse are left out."""
    rows = lines.select(F.monotonically_increasing_id().alias("n"), F.from_json("value", REPOBENCH).alias("e")).where("e.repo_name is not null")
    flat = rows.select(F.concat_ws(":", "e.repo_name", "e.file_path").alias("task_id"), F.concat_ws("\n", "e.import_statement", "e.context").alias("query"), c("e.gold_snippet_code").alias("gold"), F.posexplode("e.cross_file_context").alias("pos", "s"))
    return flat.select("task_id", "query", "gold", "pos", "s.file_path", "s.code", (c("s.code") == c("gold")).alias("is_gold"))
