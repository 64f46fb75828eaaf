"""Filters, paging, index statistics, usage analytics. "Now" is always a parameter.

Defined edge cases: empty inputs give counts and rates of 0; ties of every
ranking go to the smaller key; null keys form a group of their own unless said
otherwise; percentages and means of nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_filter(rows: DataFrame, *, languages: list[str] | None = None, path: str | None = None, kinds: list[str] | None = None, ignore_case: bool = False) -> DataFrame:
    """Rows in one of the languages (case never counts), whose path contains ``path``, of one of the kinds.

    With ``ignore_case`` the case of path and kind does not count either.
    """
    low = F.lower if ignore_case else (lambda x: x)
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    if languages:
        rows = rows.where(F.lower("language").isin([x.lower() for x in languages]))
    if path is not None:
        rows = rows.where(low(F.col("file_path")).contains(fold(path)))
    if kinds:
        rows = rows.where(low(F.col("chunk_type")).isin([fold(x) for x in kinds]))
    return rows


def without_tests(rows: DataFrame, kinds: tuple[str, ...] = ("interface", "type_alias")) -> DataFrame:
    """Rows of no test file and of none of the ``kinds``; null paths and kinds stay."""
    path, kind = F.coalesce("file_path", F.lit("")), F.coalesce("chunk_type", F.lit(""))
    return rows.where(~path.contains(".test.") & ~path.contains(".spec.") & ~path.contains("__tests__") & ~kind.isin(*kinds))


def explain(chunks: DataFrame, *, name: str | None = None, path: str | None = None, k: int | None = None, detailed: bool = False) -> DataFrame:
    """Chunks whose name contains ``name`` (case does not count) or, without a name, whose path contains ``path``.

    ``k`` keeps the first of each file by line and id. The brief form has places; ``detailed`` adds kind, summary and code. Without name and path nothing is found.
    """
    if name:
        found = chunks.where(F.lower("name").contains(name.lower()))
    else:
        found = chunks.where(F.col("file_path").contains(path)) if path else chunks.limit(0)
    if k is not None:
        w = Window.partitionBy("file_path").orderBy(F.asc_nulls_first("start_line"), "id")
        found = found.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
    brief = ["id", "name", "file_path", "start_line", "end_line"]
    return found.select(*brief, *(["chunk_type", "nl_summary", "content"] if detailed else []))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in ``order``, with ``total`` and ``pages`` (at least 1).

    The order is total, and the offset is a plan of top-k, not a sort of all rows in one task.
    """
    total = rows.agg(F.count("*")).scalar()
    wanted = rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return wanted.withColumn("total", total).withColumn("pages", F.greatest(F.lit(1), F.ceil(total / size)).cast("int"))


def daily_counts(log: DataFrame, time: str, now: str, days: int) -> DataFrame:
    """``day, n`` of the events in the ``days`` before ``now``."""
    t = F.col(time).cast("timestamp_ntz")
    stop = F.lit(now).cast("timestamp_ntz")
    return log.where((t <= stop) & (t >= stop - F.expr(f"interval {int(days)} days"))).groupBy(F.date_format(t, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, value: Column, k: int = 20) -> DataFrame:
    """``value, n`` of the ``k`` most frequent values."""
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def latency_summary(log: DataFrame, latency: str, success: Column) -> DataFrame:
    """One row: ``queries, mean_latency, error_rate``."""
    rate = F.coalesce(F.avg(F.when(success, 0.0).otherwise(1.0)), F.lit(0.0))
    return log.agg(F.count("*").alias("queries"), F.round(F.coalesce(F.avg(latency), F.lit(0.0)), 2).alias("mean_latency"), F.round(rate, 4).alias("error_rate"))


def usage_windows(log: DataFrame, time: str, now: str, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """One row: events in each trailing window, in one pass."""
    t, stop = F.col(time).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")
    return log.agg(*(F.count_if((t <= stop) & (t > stop - F.expr(f"interval {n} days"))).alias(f"last_{n}") for n in days))


def activity(keys: DataFrame, log: DataFrame, key: str, log_key: str, time: str) -> DataFrame:
    """``key, last_active, n`` of every key, also without events."""
    by = log.groupBy(F.col(log_key).alias("__k")).agg(F.max(time).alias("last_active"), F.count("*").alias("__n"))
    return keys.join(by, F.col(key) == F.col("__k"), "left").select(key, "last_active", F.coalesce("__n", F.lit(0)).alias("n"))


def percentiles(rows: DataFrame, value: str, ps: tuple[float, ...] = (50, 95, 99)) -> DataFrame:
    """One row with nearest-rank percentiles; null without values."""
    return rows.agg(*(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p:g}") for p in ps))


def value_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``: the distinct values of every key, in long form, as a hub's values may be a third of all rows."""
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def visible(rows: DataFrame, grants: DataFrame, repo: str = "repo_name", *, null_repo: str = "allow") -> DataFrame:
    """Rows by user of ``grants(user_id, repo)``: those of granted repositories, and for ``null_repo='allow'`` those without one.

    Rows without a repository stand once, under a null ``user_id``, and are every user's; they are not copied to each.
    """
    granted = rows.join(grants, rows[repo] == grants["repo"]).drop("repo")
    if null_repo != "allow":
        return granted
    return granted.unionByName(rows.where(F.col(repo).isNull()).withColumn("user_id", F.lit(None).cast("string")).select(*granted.columns))


def visible_counts(rows: DataFrame, grants: DataFrame, repo: str = "repo_name", *, null_repo: str = "allow") -> DataFrame:
    """``user_id, n`` of every user of ``grants``: rows are counted by repository before they meet the users."""
    sizes = rows.groupBy(F.col(repo).alias("repo")).agg(F.count("*").alias("rows"))
    by_user = grants.join(sizes, "repo", "left").groupBy("user_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
    free = sizes.where("repo is null").agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar() if null_repo == "allow" else F.lit(0)
    return by_user.select("user_id", (F.col("n") + free).alias("n")).where("n > 0")
