"""Work items: normalising, filtering, links to code, coverage, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

c = F.col

# fixed values: types of the trackers by common type; everything else is a task
TYPES = {"epic": "epic initiative", "story": "story user_story product_backlog_item requirement", "bug": "bug defect issue", "feature": "feature"}


def common_type(kind: Column) -> Column:
    by = {w: t for t, ws in TYPES.items() for w in ws.split()}
    table = F.create_map(*(F.lit(x) for k, v in by.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(F.trim(kind)), r"[\s-]+", "_")), F.lit("task"))


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(tags, ";"), lambda x: F.trim(x)), lambda x: x != "")


def query(items: DataFrame, *, types: list[str] | None = None, states: list[str] | None = None, assignee: str | None = None, tags: list[str] | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Items of one of the types and states, of the assignee, with all tags, whose title or description contains the text; last changed first."""
    if types:
        items = items.where(c("type").isin(types))
    if states:
        items = items.where(F.lower("state").isin([s.lower() for s in states]))
    if assignee is not None:
        items = items.where(c("assigned_to") == assignee)
    for tag in tags or []:
        items = items.where(F.array_contains("tags", tag))
    if text is not None:
        items = items.where(F.lower(F.concat_ws(" ", "title", "description")).contains(text.lower()))
    ordered = items.orderBy(F.desc("updated_at"), "id")
    return ordered if limit is None else ordered.limit(max(0, limit))


def markdown(items: DataFrame) -> DataFrame:
    """``id, chunk_id, content``: each item as a Markdown text; nulls leave no line, markup goes."""
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), c("title")),
        F.concat(F.lit("Type: "), c("type")),
        F.concat(F.lit("State: "), F.nullif("state", F.lit(""))),
        F.concat(F.lit("Tags: "), F.nullif(F.array_join("tags", ", "), F.lit(""))),
        F.regexp_replace("description", r"<[^>]+>", ""),
    )
    return items.select("id", F.concat(F.lit("backlog:"), F.replace("external_id", F.lit("#"), F.lit("-"))).alias("chunk_id"), body.alias("content"))


def digest(items: DataFrame) -> DataFrame:
    """``id, digest`` over the seven fields that make an item's text."""
    fields = ["id", "title", "description", "type", "state", "assigned_to", F.array_join("tags", ",")]
    return items.select("id", F.sha2(F.concat_ws("\u0001", *(F.coalesce(c(f) if isinstance(f, str) else f, F.lit("")) for f in fields)), 256).alias("digest"))


def links(chunks: DataFrame, items: DataFrame, kind: str = "ab") -> DataFrame:
    """``chunk_id, item_id`` of references in ``chunks(chunk_id, text)`` to items by external id; unknown references are left out."""
    prefix = {"ab": "AB#", "jira": "", "clickup": "CU-"}[kind]
    named = chunks.select("chunk_id", F.explode(T.scan_references(c("text"), kind)).alias("r")).select("chunk_id", F.concat(F.lit(prefix), "r").alias("external_id")).distinct()
    return named.join(items.select("external_id", c("id").alias("item_id")).distinct(), "external_id").select("chunk_id", "item_id")


def coverage(items: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: ``total, linked, unlinked, percent``."""
    known = items.select("id").distinct().join(linked.select(c("item_id").alias("id")).distinct().withColumn("on", F.lit(1)), "id", "left")
    total, on = F.count("*"), F.count("on")
    return known.agg(total.alias("total"), on.alias("linked"), (total - on).alias("unlinked"), F.when(total > 0, F.round(on / F.when(total > 0, total) * 100, 2)).otherwise(0.0).alias("percent"))
