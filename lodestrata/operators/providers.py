"""Pluggable models as columns: embeddings and summaries in batches.

A provider is a function of a list of texts. It runs in Arrow batches on the
executors, in the order of the rows; calls that fail give null and the error's text
instead of failing the job. Null and blank texts are not sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.vector import hash_embed
from lodestrata.operators import fusion

EmbedFn = Callable[[list[str]], list[list[float]]]
TextFn = Callable[[list[str]], list[str]]


def _apply(rows: DataFrame, text: str, provider, out: str, kind: str, batch: int) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values: list = [None] * len(pdf)
            errors: list = [None] * len(pdf)
            asked = [i for i, t in enumerate(pdf[text]) if isinstance(t, str) and t.strip()]
            for lo in range(0, len(asked), batch):
                part = asked[lo : lo + batch]
                try:
                    for i, value in zip(part, provider([pdf[text].iat[i] for i in part]), strict=True):
                        values[i] = value
                except Exception as error:  # noqa: BLE001
                    for i in part:
                        errors[i] = str(error)
            yield pdf.assign(**{out: values, f"{out}_error": errors})

    return rows.mapInPandas(run, f"{fields}, {out} {kind}, {out}_error string")


def embed(rows: DataFrame, text: str, provider: EmbedFn | None = None, batch: int = 50) -> DataFrame:
    """``rows`` with ``v`` and ``v_error``; without a provider the hash embedder, which stays in the JVM."""
    if provider is None:
        blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") == ""
        return rows.withColumn("v", F.when(~blank, hash_embed(F.col(text)).cast("array<float>"))).withColumn("v_error", F.lit(None).cast("string"))
    return _apply(rows, text, provider, "v", "array<float>", batch)


def enrich(rows: DataFrame, id_col: str, text: str, provider: TextFn, folder: str, *, batch_rows: int = 10_000, most_failures: int = 3, batch: int = 100) -> DataFrame:
    """``id_col, summary`` of all rows that have one, kept below ``folder``; what an earlier run has made is not made again.

    Rows are worked off in batches of about ``batch_rows``, each written when it is done, so a lost run
    loses one batch. After ``most_failures`` batches in a row in which every call failed, a RuntimeError
    ends the run; what was made stays. Rows whose calls failed are asked again by the next run.
    """
    spark = rows.sparkSession
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, summary string"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def made() -> DataFrame:
        if not fs.exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)

    asked = rows.where(F.col(id_col).isNotNull() & F.col(text).isNotNull() & (F.regexp_replace(text, r"\s+", "") != "")).select(id_col, text)
    todo = asked.join(made().select(id_col).distinct(), id_col, "left_anti").groupBy(id_col).agg(F.max(text).alias(text))
    total = todo.count()
    parts = -(-total // batch_rows)
    failed, run = 0, uuid.uuid4().hex
    for number in range(parts):
        part = todo.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == number)
        at = f"{folder}/run={run}/batch={number}"
        summarize(part, text, provider, batch).where("summary is not null").select(id_col, "summary").write.parquet(at)
        good = spark.read.schema(schema).parquet(at).count()
        failed = 0 if good else failed + 1
        if failed >= most_failures:
            raise RuntimeError(f"enrichment stopped: {failed} batches failed in a row")
    return made().groupBy(id_col).agg(F.max("summary").alias("summary"))


def rerank(found: DataFrame, provider: TextFn, *, query: str = "query", text: str = "text", top_n: int = 10, batch: int = 20) -> DataFrame:
    """``found(query_id, doc_id, rank, ...)`` with ``model_score`` and ``new_rank``: the first ``top_n`` of each query by the score that a model's answer names.

    The model is asked with question and text; answers are read as scores from 0 to 100, and 50 where the call fails or names none.
    """
    prompt = F.concat(F.lit("Question: "), F.coalesce(F.col(query), F.lit("")), F.lit("\nText:\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\nHow relevant is the text, from 0 to 100? Answer with the number."))
    first = found.where(F.col("rank") <= top_n).withColumn("__prompt", prompt)
    answered = _apply(first, "__prompt", provider, "answer", "string", batch)
    scored = answered.withColumn("model_score", T.parse_score(F.coalesce("answer", F.lit("")))).drop("__prompt", "answer", "answer_error")
    rest = found.where(F.col("rank") > top_n).withColumn("model_score", F.lit(None).cast(dict(scored.dtypes)["model_score"]))
    return fusion.rerank(scored.unionByName(rest), top_n=top_n)


def summarize(rows: DataFrame, text: str, provider: TextFn, batch: int = 100) -> DataFrame:
    """``rows`` with ``summary`` and ``summary_error``."""
    return _apply(rows, text, provider, "summary", "string", batch)
