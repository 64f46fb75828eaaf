"""Change detection and maintenance of stored tables by snapshot.

A store is a Parquet folder; an update is a new snapshot: kept rows by anti-join
plus the incoming rows. Applying an update twice gives what once gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, previous: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, change``: added, modified, deleted or unchanged; one full outer join.

    Null keys are no records; a null digest differs from every digest but null.
    """
    of = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(digest).alias(name), F.lit(True).alias(f"in_{name}"))
    both = of(current, "now").join(of(previous, "was"), key, "full_outer")
    change = F.when(F.col("in_was").isNull(), "added").when(F.col("in_now").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The new snapshot: incoming rows replace stored rows of their keys; of repeated incoming keys the row that is last by its other columns counts."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(last_of(incoming, key))


def last_of(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the greatest by its other columns as text, so that the same rows always give the same one."""
    rest = [x for x in rows.columns if x != key]
    if not rest:
        return rows.distinct()
    order = F.struct(*(F.to_json(F.struct(F.col(x).alias("x"))).alias(f"o{i}") for i, x in enumerate(rest)))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*(F.col(x) if x == key else F.col("__row")[x].alias(x) for x in rows.columns))


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no earlier batch has finished."""
    return items.join(done.select(key).distinct(), key, "left_anti")
