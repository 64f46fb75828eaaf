"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRACTION = 200
SALTS = 32


def salted(left: DataFrame, right: DataFrame, key: str | list[str], by: str, fraction: int = FRACTION, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt`` to join on beside ``key``.

    A key of ``left`` is hot if it holds more than ``1 / fraction`` of its rows (and
    more than 1000), so there are at most ``fraction`` hot keys, a proven bound for
    the broadcast. Rows of hot keys are spread by a hash of ``by``; only the rows that
    ``right`` has for hot keys are copied. Null keys are never hot and join nothing.
    """
    keys = [key] if isinstance(key, str) else key
    counts = left.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
    limit = counts.agg(F.greatest(F.sum("n") / fraction, F.lit(1000.0))).scalar()
    hot = F.broadcast(counts.where(F.col("n") > limit).select(*keys, F.lit(True).alias("hot")))
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return left.join(hot, keys, "left").withColumn("salt", spread).drop("hot"), right.join(hot, keys, "left").withColumn("salt", copies).drop("hot")
