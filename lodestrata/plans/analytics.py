"""Filters, listings, statistics and usage analytics over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import analytics as A
from lodestrata.operators import incremental as I
from lodestrata.plans.registry import Registry
from lodestrata.sources.tables import table

registry = Registry()
c = F.col
NOW = "2024-01-25 00:00:00"

_CH = "ch AS (SELECT DISTINCT id, content, nl_summary, file_path, start_line, end_line, language, metadata.chunk_type AS chunk_type, metadata.name AS name, metadata.repo_name AS repo_name FROM chunks)"


def _chunks(spark, d):
    cols = ["id", "content", "nl_summary", "file_path", "start_line", "end_line", "language", c("metadata.chunk_type").alias("chunk_type"), c("metadata.name").alias("name"), c("metadata.repo_name").alias("repo_name")]
    return table(spark, d, "chunks").select(*cols).distinct()


@registry.query("filter_search", f"WITH {_CH} SELECT id, file_path, chunk_type FROM ch WHERE lower(language) = 'typescript' AND contains(file_path, 'src/') AND chunk_type IN ('class', 'function')")
def filter_search(spark, d):
    return A.search_filter(_chunks(spark, d), languages=["TypeScript"], path="src/", kinds=["class", "function"]).select("id", "file_path", "chunk_type")


@registry.query("filter_search_ci", f"WITH {_CH} SELECT id, file_path, chunk_type FROM ch WHERE lower(language) = 'python' AND contains(lower(file_path), 'lib/') AND lower(chunk_type) IN ('class', 'function')")
def filter_search_ci(spark, d):
    return A.search_filter(_chunks(spark, d), languages=["Python"], path="LIB/", kinds=["Class", "FUNCTION"], ignore_case=True).select("id", "file_path", "chunk_type")


@registry.query("filter_tests", f"WITH {_CH} SELECT id FROM ch WHERE NOT contains(coalesce(file_path, ''), '.test.') AND NOT contains(coalesce(file_path, ''), '.spec.') AND NOT contains(coalesce(file_path, ''), '__tests__') AND coalesce(chunk_type, '') NOT IN ('interface', 'type_alias')")
def filter_tests(spark, d):
    return A.without_tests(_chunks(spark, d)).select("id")


@registry.query("explain", f"WITH {_CH} SELECT id, name, file_path, start_line, end_line FROM ch WHERE contains(lower(name), 'service')")
def explain(spark, d):
    """The brief form of an explanation: places without code."""
    return A.explain(_chunks(spark, d), name="service").select("id", "name", "file_path", "start_line", "end_line")


@registry.query("explain_path", f"WITH {_CH} SELECT id, name, chunk_type, file_path, start_line, end_line, nl_summary, sha256(content) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, id) AS rn FROM ch WHERE contains(file_path, 'service')) WHERE rn <= 20")
def explain_path(spark, d):
    """The full form by path: the first 20 chunks of each file whose path contains a word, with summaries and code."""
    found = A.explain(_chunks(spark, d), path="service", k=20, detailed=True)
    return found.select("id", "name", "chunk_type", "file_path", "start_line", "end_line", "nl_summary", F.sha2("content", 256).alias("digest"))


@registry.query("docs_filter", rf"WITH {_CH} SELECT id, file_path, CASE WHEN contains(file_path, 'confluence') THEN 'confluence' WHEN regexp_matches(lower(file_path), '\.mdx?$') THEN 'markdown' ELSE 'unknown' END AS source FROM ch WHERE chunk_type = 'doc'")
def docs_filter(spark, d):
    return _chunks(spark, d).where(c("chunk_type") == "doc").select("id", "file_path", T.infer_source(c("file_path")).alias("source"))


@registry.query(
    "chunk_browse",
    f"""WITH {_CH}, f AS (SELECT * FROM ch WHERE lower(language) = 'typescript' AND (contains(lower(content), 'await') OR contains(lower(nl_summary), 'await') OR contains(lower(id), 'await')))
    SELECT id, content[1:200] AS preview, (SELECT count(*) FROM f) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM f) / 20.0)) AS INT) AS pages FROM f ORDER BY id OFFSET 20 LIMIT 20""",
)
def chunk_browse(spark, d):
    q = F.lower(F.concat_ws(" ", "content", "nl_summary", "id")).contains("await")
    rows = A.search_filter(_chunks(spark, d), languages=["typescript"]).where(q).select("id", F.substring("content", 1, 200).alias("preview"))
    return A.page(rows, ["id"], 2, 20)


@registry.query("chunk_detail", "SELECT DISTINCT v.id, v.chunk_type, v.language, v.file_path, CAST(len(v.vector) AS INT) AS dim FROM vector_rows v WHERE v.vector IS NOT NULL")
def chunk_detail(spark, d):
    return table(spark, d, "vector_rows").where("vector is not null").select("id", "chunk_type", "language", "file_path", F.size("vector").alias("dim")).distinct()


@registry.query("embedding_sample", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings ORDER BY vec_id LIMIT 500")
def embedding_sample(spark, d):
    total = F.round(F.aggregate(c("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4)
    return table(spark, d, "embeddings").orderBy("vec_id").limit(500).select("vec_id", "label", total.alias("total"))


@registry.query("audit_query", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase' AND user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id LIMIT 50")
def audit_query(spark, d):
    t = c("ts").cast("timestamp_ntz")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = table(spark, d, "events").where((c("event_type") == "purchase") & (c("user_id") == 7) & t.between(at("2024-01-05"), at("2024-01-25")))
    return rows.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "ts")


_GRANTS = "g AS (SELECT DISTINCT assigned_to AS user_id, repo_name AS repo FROM backlog_items WHERE assigned_to IS NOT NULL AND repo_name IS NOT NULL)"


@registry.query("rbac_filter", f"WITH {_CH}, {_GRANTS} SELECT user_id, count(*) AS n FROM (SELECT user_id, id FROM ch JOIN g ON repo_name = repo UNION ALL SELECT u.user_id, id FROM ch, (SELECT DISTINCT user_id FROM g) u WHERE repo_name IS NULL) GROUP BY 1")
def rbac_filter(spark, d):
    grants = table(spark, d, "backlog_items").where("assigned_to is not null and repo_name is not null").select(c("assigned_to").alias("user_id"), c("repo_name").alias("repo")).distinct()
    return A.visible_counts(_chunks(spark, d).select("id", "repo_name"), grants)


@registry.query("index_stats", "SELECT count(*) AS chunks, count(DISTINCT nullif(file_path, '')) AS files, count(DISTINCT lower(language)) AS languages, max(indexed_at) AS last_indexed FROM chunks")
def index_stats(spark, d):
    return table(spark, d, "chunks").agg(F.count("*").alias("chunks"), F.countDistinct(F.nullif("file_path", F.lit(""))).alias("files"), F.countDistinct(F.lower("language")).alias("languages"), F.max("indexed_at").alias("last_indexed"))


@registry.query("language_counts", "SELECT lower(language) AS language, count(*) AS n FROM chunks GROUP BY 1")
def language_counts(spark, d):
    return table(spark, d, "chunks").groupBy(F.lower("language").alias("language")).agg(F.count("*").alias("n"))


@registry.query("chunk_kind_counts", "SELECT metadata.chunk_type AS kind, count(*) AS n FROM chunks GROUP BY 1")
def chunk_kind_counts(spark, d):
    return table(spark, d, "chunks").groupBy(c("metadata.chunk_type").alias("kind")).agg(F.count("*").alias("n"))


@registry.query("queries_per_day", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1")
def queries_per_day(spark, d):
    return A.daily_counts(table(spark, d, "events"), "ts", NOW, 14)


@registry.query("top_queries", "SELECT lower(trim(title)) AS value, count(*) AS n FROM backlog_items WHERE title IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_queries(spark, d):
    return A.top_values(table(spark, d, "backlog_items").where("title is not null"), F.lower(F.trim("title")), 20)


@registry.query("search_analytics", "SELECT count(*) AS queries, round(coalesce(avg(value), 0), 2) AS mean_latency, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN 0.0 ELSE 1.0 END), 0), 4) AS error_rate FROM events")
def search_analytics(spark, d):
    return A.latency_summary(table(spark, d, "events"), "value", c("event_type") != "error")


@registry.query("usage_stats", "SELECT " + ", ".join(f"count(*) FILTER (ts <= TIMESTAMP '{NOW}' AND ts > TIMESTAMP '{NOW}' - INTERVAL {n} DAY) AS last_{n}" for n in (1, 7, 30)) + " FROM events")
def usage_stats(spark, d):
    return A.usage_windows(table(spark, d, "events"), "ts", NOW)


@registry.query("user_activity", "SELECT c_custkey, max(ts) AS last_active, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def user_activity(spark, d):
    return A.activity(table(spark, d, "customer").select("c_custkey"), table(spark, d, "events"), "c_custkey", "user_id", "ts")


@registry.query("team_analytics", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def team_analytics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@registry.query("latency_percentiles", "SELECT quantile_disc(value, 0) AS p0, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 1) AS p100 FROM events")
def latency_percentiles(spark, d):
    return A.percentiles(table(spark, d, "events"), "value", (0, 50, 95, 99, 100))


@registry.query("line_counts", "SELECT repo_name, count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM scanned_files WHERE content IS NOT NULL GROUP BY 1")
def line_counts(spark, d):
    return table(spark, d, "scanned_files").where("content is not null").groupBy("repo_name").agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n", -1))).alias("lines"))


def _index_sql(key: str, value: str, source: str) -> str:
    return f"SELECT DISTINCT {key}, {value} FROM {source} WHERE {key} IS NOT NULL AND {value} IS NOT NULL"


@registry.query("name_index", f"WITH {_CH} " + _index_sql("name", "id", "ch"))
def name_index(spark, d):
    return A.value_index(_chunks(spark, d), "name", "id")


@registry.query("file_index", f"WITH {_CH} " + _index_sql("file_path", "id", "ch"))
def file_index(spark, d):
    return A.value_index(_chunks(spark, d), "file_path", "id")


@registry.query("caller_map", _index_sql("target", "source", "(SELECT * FROM graph_edges WHERE type = 'calls')"))
def caller_map(spark, d):
    return A.value_index(table(spark, d, "graph_edges").where("type = 'calls'"), "target", "source")


@registry.query("repo_rollup", "SELECT repo_name, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(files) AS BIGINT) AS files FROM (SELECT metadata.repo_name AS repo_name, 1 AS chunks, 0 AS files FROM chunks UNION ALL SELECT repo_name, 0, 1 FROM scanned_files) GROUP BY ROLLUP (repo_name)")
def repo_rollup(spark, d):
    chunks = table(spark, d, "chunks").select(c("metadata.repo_name").alias("repo_name"), F.lit(1).alias("chunks"), F.lit(0).alias("files"))
    files = table(spark, d, "scanned_files").select("repo_name", F.lit(0).alias("chunks"), F.lit(1).alias("files"))
    return chunks.unionByName(files).rollup("repo_name").agg(F.sum("chunks").alias("chunks"), F.sum("files").alias("files"))


@registry.query("history_page", "SELECT event_id, user_id, ts, (SELECT count(*) FROM events WHERE event_type = 'click') AS total, CAST(greatest(1, ceil((SELECT count(*) FROM events WHERE event_type = 'click') / 25.0)) AS INT) AS pages FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id OFFSET 50 LIMIT 25")
def history_page(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    return A.page(rows, [F.desc("ts"), "event_id"], 3, 25)


@registry.query("retain_latest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1000")
def retain_latest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(1000).select("event_id", "ts")


@registry.query("latest_by_file", "SELECT file_path, file_id, scanned_at FROM (SELECT DISTINCT file_path, file_id, scanned_at, row_number() OVER (PARTITION BY file_path ORDER BY scanned_at DESC, file_id DESC) AS rn FROM scanned_files) WHERE rn = 1")
def latest_by_file(spark, d):
    """The last life of every path."""
    best = F.max_by(F.struct("file_id", "scanned_at"), F.struct("scanned_at", "file_id"))
    return table(spark, d, "scanned_files").groupBy("file_path").agg(best.alias("b")).select("file_path", "b.file_id", "b.scanned_at")


@registry.query("scan_hash", "SELECT DISTINCT file_id, file_path, sha256(content) AS content_hash, sha256(content) = content_hash AS same FROM scanned_files WHERE content IS NOT NULL")
def scan_hash(spark, d):
    digest = F.sha2("content", 256)
    return table(spark, d, "scanned_files").where("content is not null").select("file_id", "file_path", digest.alias("h"), "content_hash").select("file_id", "file_path", c("h").alias("content_hash"), (c("h") == c("content_hash")).alias("same")).distinct()


_NOW_FILES = "SELECT DISTINCT file_path, content_hash FROM scanned_files WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '2026-03-01'"
_OLD_FILES = "SELECT DISTINCT file_path, content_hash FROM scanned_files WHERE scanned_at <= TIMESTAMP '2025-12-01' AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '2025-12-01')"


def _living(spark, d, at: str, *, after: bool):
    files = table(spark, d, "scanned_files")
    stamp = F.lit(at).cast("timestamp_ntz")
    alive = c("deleted_at").isNull() | (c("deleted_at").cast("timestamp_ntz") > stamp)
    return files.where(alive if after else alive & (c("scanned_at").cast("timestamp_ntz") <= stamp)).select("file_path", "content_hash")


@registry.query(
    "detect_changes",
    f"""WITH n AS (SELECT file_path, max(content_hash) AS h FROM ({_NOW_FILES}) GROUP BY 1), o AS (SELECT file_path, max(content_hash) AS h FROM ({_OLD_FILES}) GROUP BY 1)
    SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'deleted' WHEN n.h IS NOT DISTINCT FROM o.h THEN 'unchanged' ELSE 'modified' END AS change FROM n FULL OUTER JOIN o ON n.file_path = o.file_path""",
)
def detect_changes(spark, d):
    """Files of March 2026 against those of December 2025."""
    return I.detect_changes(_living(spark, d, "2026-03-01", after=True), _living(spark, d, "2025-12-01", after=False), "file_path", "content_hash")


@registry.query("store_count", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM vector_rows")
def store_count(spark, d):
    return table(spark, d, "vector_rows").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@registry.query("store_get", "SELECT DISTINCT v.id, v.chunk_type, v.file_path FROM vector_rows v WHERE v.id IN (SELECT id FROM chunks WHERE metadata.chunk_type = 'interface')")
def store_get(spark, d):
    """Point lookups as one semi-join."""
    wanted = table(spark, d, "chunks").where(c("metadata.chunk_type") == "interface").select("id")
    return table(spark, d, "vector_rows").join(wanted, "id", "left_semi").select("id", "chunk_type", "file_path").distinct()


@registry.query(
    "store_upsert",
    "WITH inc AS (SELECT id, upper(chunk_type) AS chunk_type FROM vector_rows WHERE language = 'python'), i AS (SELECT id, max(chunk_type) AS chunk_type FROM inc GROUP BY 1) SELECT chunk_type, count(*) AS n FROM (SELECT id, chunk_type FROM vector_rows WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT * FROM i) GROUP BY 1",
)
def store_upsert(spark, d):
    rows = table(spark, d, "vector_rows").select("id", "chunk_type", "language")
    incoming = rows.where("language = 'python'").groupBy("id").agg(F.max(F.upper("chunk_type")).alias("chunk_type"))
    return I.upsert(rows.select("id", "chunk_type"), incoming, "id").groupBy("chunk_type").agg(F.count("*").alias("n"))


@registry.query("store_delete", "SELECT id, chunk_type FROM vector_rows WHERE id NOT IN (SELECT id FROM chunks WHERE language IS NULL)")
def store_delete(spark, d):
    gone = table(spark, d, "chunks").where("language is null")
    return I.delete(table(spark, d, "vector_rows").select("id", "chunk_type"), gone, "id")


@registry.query("enrich_resume", "SELECT DISTINCT id FROM chunks WHERE id NOT IN (SELECT id FROM chunks WHERE nl_summary IS NOT NULL)")
def enrich_resume(spark, d):
    """Chunks whose summary is still to be made."""
    chunks = table(spark, d, "chunks")
    return I.pending(chunks.select("id"), chunks.where("nl_summary is not null"), "id").distinct()


@registry.query("enrich_summary", r"SELECT DISTINCT id, coalesce(nl_summary, nullif(trim(regexp_extract(content, '^\s*([^\n.]+)', 1)), ''), '(empty)') AS summary FROM chunks")
def enrich_summary(spark, d):
    """Summaries; where none was delivered, the first sentence of the first line stands in for a model."""
    first = F.trim(F.regexp_extract("content", r"^\s*([^\n.]+)", 1))
    return table(spark, d, "chunks").select("id", F.coalesce("nl_summary", F.nullif(first, F.lit("")), F.lit("(empty)")).alias("summary")).distinct()


@registry.query("index_health", "SELECT 'chunks' AS store, count(*) > 0 AS filled FROM chunks UNION ALL SELECT 'vector_rows', count(*) > 0 FROM vector_rows UNION ALL SELECT 'graph_nodes', count(*) > 0 FROM graph_nodes")
def index_health(spark, d):
    parts = [table(spark, d, n).agg((F.count("*") > 0).alias("filled")).select(F.lit(n).alias("store"), "filled") for n in ("chunks", "vector_rows", "graph_nodes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@registry.query("runner_overlap", "SELECT sum(a) AS only_or_both_a, sum(b) AS only_or_both_b, sum(a * b) AS both_n, count(*) AS all_n FROM (SELECT file_path, max(a) AS a, max(b) AS b FROM (SELECT file_path, 1 AS a, 0 AS b FROM chunks UNION ALL SELECT file_path, 0, 1 FROM scanned_files) WHERE file_path IS NOT NULL GROUP BY 1)")
def runner_overlap(spark, d):
    """Files that two systems found, by one or by both."""
    of = lambda name, a, b: table(spark, d, name).where("file_path is not null").select("file_path", F.lit(a).alias("a"), F.lit(b).alias("b"))
    by = of("chunks", 1, 0).unionByName(of("scanned_files", 0, 1)).groupBy("file_path").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return by.agg(F.sum("a").alias("only_or_both_a"), F.sum("b").alias("only_or_both_b"), F.sum(c("a") * c("b")).alias("both_n"), F.count("*").alias("all_n"))


@registry.query(
    "grep_rank",
    r"SELECT file_path, count(*) AS n FROM (SELECT file_path, unnest(string_split(content, chr(10))) AS line FROM scanned_files WHERE content IS NOT NULL) WHERE regexp_matches(line, 'password|secret|token') GROUP BY 1 ORDER BY n DESC, file_path LIMIT 50",
)
def grep_rank(spark, d):
    lines = table(spark, d, "scanned_files").where("content is not null").select("file_path", F.explode(F.split("content", "\n", -1)).alias("line"))
    return lines.where(c("line").rlike("password|secret|token")).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(50)


@registry.query("minmax_normalize", "SELECT vec_id, round(CASE WHEN max(x) OVER () = min(x) OVER () THEN 0.5 ELSE (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) END, 6) AS x FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)")
def minmax_normalize(spark, d):
    from lodestrata.operators.visual import minmax

    rows = table(spark, d, "embeddings").select("vec_id", c("embedding")[0].cast("double").alias("x"))
    return minmax(rows, ["x"]).select("vec_id", F.round("x", 6).alias("x"))


@registry.query("project_3d", "SELECT vec_id, round(x * cos(0.5) - z * sin(0.5), 6) AS px, round(y * cos(0.3) - (x * sin(0.5) + z * cos(0.5)) * sin(0.3), 6) AS py FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)")
def project_3d(spark, d):
    from lodestrata.functions.vector import project_3d as project

    e = [c("embedding")[i].cast("double") for i in range(3)]
    px, py = project(*e, 0.5, 0.3)
    return table(spark, d, "embeddings").select("vec_id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@registry.query("top_directory", "SELECT string_split(file_path, '/')[1] AS dir, count(*) AS n, count(DISTINCT file_path) AS files FROM chunks WHERE file_path IS NOT NULL GROUP BY 1")
def top_directory(spark, d):
    return table(spark, d, "chunks").where("file_path is not null").groupBy(F.split("file_path", "/")[0].alias("dir")).agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
