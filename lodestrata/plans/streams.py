"""Windows over events, rate limits, sources, pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import fusion, visual
from lodestrata.plans.registry import Registry
from lodestrata.sources import files as S
from lodestrata.sources.tables import table
from lodestrata.streaming import limiter, windows

registry = Registry()
c = F.col


def _events(spark, d):
    return table(spark, d, "events")


@registry.query(
    "debounce_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM s GROUP BY user_id, s.n""",
)
def debounce_sessions(spark, d):
    return windows.sessions(_events(spark, d), "user_id", "event_type", gap="2 hours")


@registry.query("events_daily", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_daily(spark, d):
    return windows.tumbling(_events(spark, d), ["event_type"], "value")


@registry.query(
    "events_sliding",
    "SELECT date_trunc('day', ts)::TIMESTAMP - to_days(CAST(k AS INT)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(0, 7)) AS k) GROUP BY 1, 2",
)
def events_sliding(spark, d):
    return windows.sliding(_events(spark, d), ["event_type"], "value")


# the bucket of each user by recursion over the user's events: level after the event, and its instant
_LIMIT = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s(event_id, user_id, n, since, before) AS (
  SELECT event_id, user_id, n, t, 5.0::DOUBLE FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.n, greatest(s.since, e.t), CASE WHEN e.t > s.since THEN least(5.0, (CASE WHEN before >= 1 THEN before - 1 ELSE before END) + (e.t - s.since) / 3600 * 5) ELSE CASE WHEN before >= 1 THEN before - 1 ELSE before END END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1
 )
 SELECT event_id, user_id, before >= 1 AS allowed, round(CASE WHEN before >= 1 THEN 0 ELSE (1 - before) / 5 * 3600 END, 6) AS retry_after FROM s"""


@registry.query("rate_limit", _LIMIT)
def rate_limit(spark, d):
    return limiter.limit(_events(spark, d), "user_id", "ts", "event_id", capacity=5, window=3600)


@registry.query("ignore_filter", r"SELECT DISTINCT file_path FROM scanned_files WHERE NOT regexp_matches(file_path, '(^|/)(node_modules|dist|vendor)/') AND (NOT regexp_matches(file_path, '(^|/)[^/]*\.min\.[^/]*(/|$)') OR regexp_matches(file_path, '(^|/)[^/]*\.min\.css(/|$)')) AND NOT regexp_matches(file_path, '^(.*/)?conf/[^/]*\.yaml(/|$)')")
def ignore_filter(spark, d):
    rules = ["# comment", "", "*.min.*", "!*.min.css", "**/conf/*.yaml", "node_modules/", "dist/", "vendor/"]
    return table(spark, d, "scanned_files").select("file_path").distinct().where(~S.ignored(c("file_path"), rules))


_STATUS = "CASE file_id % 4 WHEN 0 THEN 'A' || chr(9) || file_path WHEN 1 THEN 'M' || chr(9) || file_path WHEN 2 THEN 'D' || chr(9) || file_path ELSE 'R100' || chr(9) || 'old/' || file_path || chr(9) || file_path END"


@registry.query("git_status_parse", "SELECT DISTINCT CASE file_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS change, file_path, CASE WHEN file_id % 4 = 3 THEN 'old/' || file_path END AS old_path FROM scanned_files")
def git_status_parse(spark, d):
    """Changes written as ``diff --name-status`` prints them, and parsed."""
    tab, k = F.lit("\t"), c("file_id") % 4
    line = F.when(k == 3, F.concat(F.lit("R100"), tab, F.lit("old/"), "file_path", tab, "file_path")).otherwise(F.concat(F.when(k == 0, "A").when(k == 1, "M").otherwise("D"), tab, "file_path"))
    return S.name_status(table(spark, d, "scanned_files").select(line.alias("line")).distinct())


@registry.query("csv_report", "SELECT CASE WHEN regexp_matches(t, '[\",\\n\\r]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END || ',' || CAST(doc_id AS VARCHAR) || ',' || coalesce(lang, '') AS line FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)".replace("\\n\\r", chr(92) + "n" + chr(92) + "r"))
def csv_report(spark, d):
    return S.to_csv(table(spark, d, "documents"), ["text", "doc_id", "lang"])


@registry.query("jsonl_roundtrip", "SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def jsonl_roundtrip(spark, d):
    """Events as JSON lines with a broken line each, parsed with a schema; what does not parse is left out."""
    line = F.to_json(F.struct("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")))
    lines = _events(spark, d).select(F.explode(F.array(line, F.lit('{"event_id": '))).alias("value"))
    rows = lines.select(F.from_json("value", "event_id bigint, user_id bigint, event_type string, k int").alias("e")).select("e.*")
    return rows.where("event_id is not null")


def _graph(spark, d):
    rows = table(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), c("embedding").alias("v"))
    near = fusion.vector_topk(rows.withColumnRenamed("doc_id", "query_id"), rows, 15, exclude_self=True)
    return visual.fuzzy_graph(near.select(c("query_id").alias("id"), c("doc_id").alias("neighbour"), (1 - c("score")).alias("distance")))


@registry.query("umap_fuzzy_graph")
def umap_fuzzy_graph(spark, d):
    return _graph(spark, d).select("a", "b", F.round("weight", 6).alias("weight"))


@registry.query("umap_layout")
def umap_layout(spark, d):
    return visual.minmax(visual.layout(_graph(spark, d)), ["x", "y"]).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_PAGE_TEXT = "repo_name || ' (' || source || ')' || chr(10) || 'no ' || doc_id"


@registry.query("pdf_text", f"SELECT 'd/' || doc_id || '.pdf' AS path, {_PAGE_TEXT} AS text FROM documents WHERE repo_name IS NOT NULL AND source IS NOT NULL")
def pdf_text(spark, d):
    """Documents' headings written as uncompressed PDF text blocks, and read."""
    rows = table(spark, d, "documents").where("repo_name is not null and source is not null")
    body = F.concat(F.lit("%PDF-1.4\nBT ("), "repo_name", F.lit(" \\("), "source", F.lit("\\)) Tj ET\nBT [(no ) -3 ("), c("doc_id").cast("string"), F.lit(")] TJ ET\n"))
    return S.office_text(rows.select(F.concat(F.lit("d/"), c("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode(body, "UTF-8").alias("content")))


@registry.query("docx_text", "SELECT 'd/' || doc_id || '.docx' AS path, repo_name || ' & ' || source || chr(10) || doc_path AS text FROM documents WHERE repo_name IS NOT NULL AND source IS NOT NULL AND doc_path IS NOT NULL")
def docx_text(spark, d):
    """Documents' headings written as word-processor files, and read."""
    rows = table(spark, d, "documents").where("repo_name is not null and source is not null and doc_path is not null")
    xml = F.concat(F.lit("<w:p><w:t>"), "repo_name", F.lit(" &amp; "), "source", F.lit("</w:t></w:p><w:p><w:t>"), "doc_path", F.lit("</w:t></w:p>"))
    packed = rows.select(F.concat(F.lit("d/"), c("doc_id").cast("string"), F.lit(".docx")).alias("path"), xml.alias("xml")).mapInPandas(_zip, "path string, content binary")
    return S.office_text(packed)


def _zip(batches):
    import io
    import zipfile

    for pdf in batches:
        out = []
        for xml in pdf.xml:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("word/document.xml", xml)
            out.append(buffer.getvalue())
        yield pdf[["path"]].assign(content=out)
