"""References to records that do not exist at their time.

A reference row names a key and a time; a parent row is one life of a key,
from ``start`` (inclusive) to ``end`` (exclusive, null: still living). The
references that no life covers are found by a distributed left anti-join of
the distinct (key, time) pairs against the lives, and joined back to the rows.

Defined edge cases
    * null, empty and blank keys are no references;
    * a null reference time asks whether the key ever existed;
    * a null ``start`` means "since ever"; a life with ``end <= start`` covers nothing;
    * repeated rows, on either side, change nothing;
    * an empty parent table makes every reference an orphan.

Skew: distinct pairs are formed with map-side combine before any join; keys that
hold a large share of the distinct pairs are spread over salts, to which only
those keys' merged lives are copied (``operators/skew.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.skew import salted


def clean_path(path: Column) -> Column:
    """A path reference without surrounding blanks, leading ``./`` or ``/``, backslashes and line marks."""
    slashed = F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/")
    unmarked = F.regexp_replace(slashed, r"(#L\d+(-L?\d+)?|:\d+)$", "")
    return F.regexp_replace(unmarked, r"^(\./|/)+", "")


def not_blank(key: Column) -> Column:
    return key.isNotNull() & (F.regexp_replace(key, r"\s+", "") != "")


def merged_lives(parents: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Disjoint lives ``(k, lo, hi)`` per key; ``hi`` null: still living.

    Merged twice: first inside a key and month, which splits a hot key over its
    months and usually leaves few rows, then over the whole key.
    """
    lives = (
        parents.where(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.coalesce(F.col(start).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("lo"), F.col(end).cast("timestamp_ntz").alias("hi"))
        .where(F.col("hi").isNull() | (F.col("hi") > F.col("lo")))
        .groupBy("k", "lo")
        .agg(F.max(F.coalesce("hi", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("hi"))
    )

    def merge(df: DataFrame, by: list) -> DataFrame:
        before = Window.partitionBy(*by).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        running = Window.partitionBy(*by).orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
        opened = df.withColumn("new", F.when(F.max("hi").over(before) >= F.col("lo"), 0).otherwise(1))
        return opened.withColumn("island", F.sum("new").over(running)).groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    monthly = merge(lives.withColumn("m", F.date_trunc("month", "lo")), ["k", "m"]).select("k", "lo", "hi")
    return merge(monthly, ["k"]).select("k", "lo", F.when(F.col("hi") < F.lit("9999-12-31").cast("timestamp_ntz"), F.col("hi")).alias("hi"))


def orphans(references: DataFrame, parents: DataFrame, *, key: str, time: str, parent_key: str, parent_start: str, parent_end: str, on: str | None = None) -> DataFrame:
    """Rows of ``references`` whose ``key`` has no living parent at ``time``.

    ``on`` names a column of ``references`` that holds the key in the form in
    which parents store it, where that differs from ``key``. The result has the
    columns of ``references``; a row that occurs n times there occurs n times here.
    """
    join_key = on or key
    rows = references.where(not_blank(F.col(key)) & F.col(join_key).isNotNull())
    pairs = rows.select(F.col(join_key).alias("k"), F.col(time).cast("timestamp_ntz").alias("t")).distinct()
    left, right = salted(pairs, merged_lives(parents, parent_key, parent_start, parent_end), "k", "t")
    alive = (F.col("p.k") == F.col("c.k")) & (F.col("p.salt") == F.col("c.salt")) & (F.col("c.t").isNull() | ((F.col("p.lo") <= F.col("c.t")) & (F.col("p.hi").isNull() | (F.col("c.t") < F.col("p.hi")))))
    missing = left.alias("c").join(right.alias("p"), alive, "left_anti").select(F.col("k").alias("__k"), F.col("t").alias("__t"))
    back = (F.col(join_key) == F.col("__k")) & F.col(time).cast("timestamp_ntz").eqNullSafe(F.col("__t"))
    return rows.join(missing, back, "left_semi")


def edge_references(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as references ``(ref_table, ref_field, ref_id, ref_key, lookup, at)``."""
    ends = F.explode(F.array(*(F.struct(F.lit(end).alias("ref_field"), F.col(end).alias("ref_key")) for end in ("source", "target"))))
    return edges.select(F.col("edge_id").cast("string").alias("ref_id"), F.col("observed_at").alias("at"), ends.alias("e")).select(
        F.lit("graph_edges").alias("ref_table"), "e.ref_field", "ref_id", "e.ref_key", F.col("e.ref_key").alias("lookup"), "at"
    )


def backlog_references(items: DataFrame) -> DataFrame:
    """Linked code paths of every work item, with the cleaned path as ``lookup``."""
    exploded = items.select(F.col("id").alias("ref_id"), F.col("updated_at").alias("at"), F.explode("linked_code_paths").alias("ref_key"))
    return exploded.select(F.lit("backlog_items").alias("ref_table"), F.lit("linked_code_paths").alias("ref_field"), "ref_id", "ref_key", clean_path(F.col("ref_key")).alias("lookup"), "at")


def project_orphans(nodes: DataFrame, edges: DataFrame, files: DataFrame, items: DataFrame) -> DataFrame:
    """All orphan references of the project, one row per occurrence, with their time ``at``."""
    of_edges = orphans(edge_references(edges), nodes, key="ref_key", time="at", on="lookup", parent_key="id", parent_start="first_seen_at", parent_end="deleted_at")
    paths = files.select(clean_path(F.col("file_path")).alias("path"), "scanned_at", "deleted_at")
    of_items = orphans(backlog_references(items), paths, key="ref_key", time="at", on="lookup", parent_key="path", parent_start="scanned_at", parent_end="deleted_at")
    return of_edges.unionByName(of_items)


def count_by_period(found: DataFrame, period: str = "month") -> DataFrame:
    """Distinct orphan references per table, field and period (null time: null period)."""
    distinct = found.select("ref_table", "ref_field", "ref_id", "ref_key", "at").distinct()
    return distinct.groupBy("ref_table", "ref_field", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("orphans"), F.countDistinct("ref_key").alias("keys"))
