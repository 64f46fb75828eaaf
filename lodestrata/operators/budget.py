"""Token budgets and context assembly.

Token counts are not negative, so a running sum never falls and "take while it
fits" is a filter on it. Groups are the results of one query, bounded by their k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import token_estimate


def fill(rows: DataFrame, budget: int, order: list, by: list[str], tokens: str = "tokens", *, first_always: bool = False) -> DataFrame:
    """Rows, in order, until the next would exceed ``budget``; with ``first_always`` the first counts even if it exceeds it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("used", F.sum(tokens).over(w)).withColumn("n", F.count("*").over(w))
    return run.where((F.col("used") <= budget) | (F.lit(first_always) & (F.col("n") == 1)))


def _fenced(*head: Column, text: Column) -> Column:
    return F.concat_ws("\n", *head, F.lit("```"), text, F.lit("```"))


def format_primary(name: Column, kind: Column, path: Column, first: Column, last: Column, summary: Column, text: Column) -> Column:
    """A result as text: heading, place, summary, code; what is null or empty is left out."""
    head = F.when(F.coalesce(name, F.lit("")) != "", F.format_string("### %s (%s)", name, F.coalesce(kind, F.lit("unknown")))).otherwise("### (unnamed chunk)")
    lines = F.when(first.isNotNull() & last.isNotNull(), F.format_string(" [L%d-%d]", first.cast("int"), last.cast("int"))).otherwise("")
    place = F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("File: "), path, lines))
    return _fenced(head, place, F.nullif(summary, F.lit("")), text=text)


def format_related(name: Column, relationship: Column, distance: Column, path: Column, summary: Column, text: Column) -> Column:
    """A related chunk as text, with its relationship and distance."""
    head = F.format_string("### %s [%s, distance=%d]", F.coalesce(name, F.lit("unknown")), F.coalesce(relationship, F.lit("related")), distance.cast("int"))
    return _fenced(head, F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("File: "), path)), F.nullif(summary, F.lit("")), text=text)


def format_graph(nodes: Column, edges: Column) -> Column:
    """Nodes on one line and edges ``ARRAY<STRUCT<source, target, type>>`` on one each; empty without nodes."""
    arrows = F.transform(edges, lambda e: F.concat(e["source"], F.lit(" --["), e["type"], F.lit("]--> "), e["target"]))
    return F.when(F.size(nodes) > 0, F.array_join(F.concat(F.array(F.concat(F.lit("Nodes: "), F.array_join(nodes, ", "))), arrows), "\n")).otherwise("")


def assemble(primary: DataFrame, related: DataFrame, graph: DataFrame | None = None, *, max_tokens: int = 8000, reserve: int = 2000, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """One row per query: ``query_id, content, n_primary, n_related, has_graph, tokens, truncated``.

    ``primary(query_id, id, text, score)`` by falling score, ``related(query_id, id, text, distance)`` by distance, each
    with ``name, chunk_type, file_path, start_line, end_line, summary, relationship`` where known; ``graph(query_id, nodes, edges)``,
    one row per query. Each section has its share of ``max_tokens - reserve``; results and related chunks are taken in order while
    they fit, the graph as a whole or not at all. Tokens are counted on the formatted text.
    """
    room = max(0, max_tokens - reserve)
    known = lambda rows, x: F.col(x) if x in rows.columns else F.lit(None)
    text = lambda rows, x: known(rows, x).cast("string")
    one = primary.withColumn("text", format_primary(text(primary, "name"), text(primary, "chunk_type"), text(primary, "file_path"), known(primary, "start_line"), known(primary, "end_line"), text(primary, "summary"), F.col("text")))
    two = related.withColumn("text", format_related(text(related, "name"), text(related, "relationship"), F.col("distance"), text(related, "file_path"), text(related, "summary"), F.col("text")))
    part = lambda rows, share, order: fill(rows.withColumn("tokens", token_estimate(F.col("text"))), int(share * room), order, ["query_id"])
    first, second = part(one, weights[0], [F.desc("score"), "id"]), part(two, weights[1], ["distance", "id"])

    def body(rows: DataFrame, title: str, mark: str) -> DataFrame:
        # the results of one query are bounded by its budget
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
        return rows.groupBy("query_id").agg(F.concat(F.lit(f"## {title}\n\n"), texts).alias(f"{mark}b"), F.count("*").alias(f"{mark}k"), F.sum("tokens").alias(f"{mark}s"))

    offered = primary.select("query_id").unionByName(related.select("query_id")).groupBy("query_id").agg(F.count("*").alias("offered"))
    joined = offered.join(body(first, "Primary Results", "p"), "query_id", "left").join(body(second, "Related Context", "r"), "query_id", "left")
    if graph is None:
        joined = joined.withColumn("gt", F.lit(""))
    else:
        joined = joined.join(graph.select("query_id", format_graph(F.col("nodes"), F.col("edges")).alias("gt")), "query_id", "left").withColumn("gt", F.coalesce("gt", F.lit("")))
    zero = lambda x: F.coalesce(x, F.lit(0))
    cost = token_estimate(F.col("gt"))
    fits = cost <= int(weights[2] * room)
    kept = zero(F.col("pk")) + zero(F.col("rk"))
    shown = F.when(fits & (F.col("gt") != ""), F.concat(F.lit("## Dependency Graph\n\n"), F.col("gt")))
    return joined.select(
        "query_id", F.concat_ws("\n", "pb", "rb", shown).alias("content"), zero(F.col("pk")).alias("n_primary"), zero(F.col("rk")).alias("n_related"), shown.isNotNull().alias("has_graph"),
        (zero(F.col("ps")) + zero(F.col("rs")) + F.when(fits, cost).otherwise(0)).alias("tokens"), ((kept < F.col("offered")) | ~fits).alias("truncated"),
    )
