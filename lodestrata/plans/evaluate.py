"""Budgets and evaluation. Runs are the cosine neighbours of the vectors whose id is divisible by 50; vectors of the same label are relevant."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import budget as B
from lodestrata.operators import evaluate as E
from lodestrata.operators import fusion
from lodestrata.plans.registry import Registry
from lodestrata.sources.tables import table

registry = Registry()
c = F.col

_RUNS = """vec AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, q.label AS ql, e.label AS el, round(greatest(-1, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
 runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM vec) WHERE rank <= 20),
 sizes AS (SELECT q.vec_id AS query_id, q.label, count(e.vec_id) AS n_rel FROM embeddings q LEFT JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
 fl AS (SELECT *, CASE WHEN ql = el THEN 1 ELSE 0 END AS hit, sum(CASE WHEN ql = el THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hs FROM runs),
 s AS (SELECT query_id, sum(hit) FILTER (rank <= 5) AS h5, sum(hit) FILTER (rank <= 10) AS h10, min(rank) FILTER (hit = 1) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10 AND hit = 1), 0) AS dcg, coalesce(sum(hs / rank) FILTER (hit = 1), 0) AS pr, sum(hit) AS hits FROM fl GROUP BY 1),
 m AS (SELECT query_id, label, h5 / 5 AS p_5, h10 / 10 AS p_10, h5 / n_rel AS r_5, h10 / n_rel AS r_10, coalesce(1 / f, 0) AS mrr, dcg / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, pr / n_rel AS ap, CASE WHEN hits > 0 THEN pr / hits ELSE 0 END AS ctx_precision FROM s JOIN sizes USING (query_id))"""
_COLS = ["p_5", "p_10", "r_5", "r_10", "mrr", "ndcg", "ap", "ctx_precision"]


def _runs(spark, d, k=20):
    rows = table(spark, d, "embeddings").select(c("vec_id").alias("doc_id"), c("embedding").alias("v"))
    asked = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return fusion.vector_topk(asked, rows, k, exclude_self=True).select("query_id", c("doc_id").alias("item_id"), "rank", "score")


def _qrels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), "label")
    return q.join(e.withColumnRenamed("vec_id", "item_id"), "label").where("query_id <> item_id").select("query_id", "item_id")


def _metrics(spark, d):
    return E.ir_metrics(_runs(spark, d), _qrels(spark, d))


def _rounded(rows, keys, cols):
    return rows.select(*keys, *(F.round(x, 6).alias(x) for x in cols))


@registry.query("ir_metrics", f"WITH {_RUNS} SELECT query_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in _COLS) + " FROM m")
def ir_metrics(spark, d):
    return _rounded(_metrics(spark, d), ["query_id"], _COLS)


@registry.query("ir_aggregate", f"WITH {_RUNS} SELECT count(*) AS queries, " + ", ".join(f"round(avg({x}), 6) AS {x}" for x in _COLS) + " FROM m")
def ir_aggregate(spark, d):
    return E.averages(_metrics(spark, d), [], _COLS)


@registry.query("ir_by_type", f"WITH {_RUNS} SELECT label, count(*) AS queries, " + ", ".join(f"round(avg({x}), 6) AS {x}" for x in _COLS) + " FROM m GROUP BY 1")
def ir_by_type(spark, d):
    labels = table(spark, d, "embeddings").select(c("vec_id").alias("query_id"), "label")
    return E.averages(_metrics(spark, d).join(labels, "query_id"), ["label"], _COLS)


_ITEMS = "items AS (SELECT DISTINCT id, file_path AS query_id, metadata.chunk_type AS kind, coalesce(start_line, 1) AS line, CAST(ceil(length(content) / 4.0) AS INT) AS tokens FROM chunks WHERE content IS NOT NULL AND file_path IS NOT NULL), run AS (SELECT *, sum(tokens) OVER w AS used, row_number() OVER w AS n FROM items WINDOW w AS (PARTITION BY query_id ORDER BY line, id ROWS UNBOUNDED PRECEDING))"


def _items(spark, d):
    rows = table(spark, d, "chunks").where("content is not null and file_path is not null")
    return rows.select("id", c("file_path").alias("query_id"), c("metadata.chunk_type").alias("kind"), F.coalesce("start_line", F.lit(1)).alias("line"), T.token_estimate(c("content")).alias("tokens")).distinct()


@registry.query("token_budget", f"WITH {_ITEMS} SELECT id, query_id, CAST(used AS BIGINT) AS used FROM run WHERE used <= 300")
def token_budget(spark, d):
    return B.fill(_items(spark, d), 300, ["line", "id"], ["query_id"]).select("id", "query_id", "used")


@registry.query("token_budget_topk", f"WITH {_ITEMS} SELECT id, query_id, CAST(used AS BIGINT) AS used FROM run WHERE used <= 300 OR n = 1")
def token_budget_topk(spark, d):
    return B.fill(_items(spark, d), 300, ["line", "id"], ["query_id"], first_always=True).select("id", "query_id", "used")


@registry.query("noise_ratio", f"WITH {_ITEMS} SELECT query_id, CAST(sum(tokens) AS BIGINT) AS total, round(CASE WHEN sum(tokens) <= 0 THEN 0 WHEN coalesce(sum(tokens) FILTER (kind = 'function'), 0) <= 0 THEN 1 ELSE 1 - coalesce(sum(tokens) FILTER (kind = 'function'), 0) / sum(tokens) END, 6) AS noise FROM items GROUP BY 1")
def noise_ratio(spark, d):
    relevant = F.sum(F.when(c("kind") == "function", c("tokens")).otherwise(0))
    sums = _items(spark, d).groupBy("query_id").agg(F.sum("tokens").alias("total"), relevant.alias("relevant"))
    return sums.select("query_id", "total", F.round(E.noise_ratio(c("relevant"), c("total")), 6).alias("noise"))


def _context_sql(source: str, order_p: str, order_r: str, graph: str = "") -> str:
    """Sections of formatted texts ``p`` and ``r`` (query_id, f), of 1500 tokens by shares, and a graph text ``g``."""
    run = lambda t, order: f"SELECT *, CAST(ceil(length(f) / 4.0) AS INT) AS tokens, sum(CAST(ceil(length(f) / 4.0) AS INT)) OVER (PARTITION BY query_id ORDER BY {order}) AS used, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS n FROM {t}"
    body = lambda t, title, most: f"SELECT query_id, '## {title}' || chr(10) || chr(10) || string_agg(f, chr(10) ORDER BY n) AS b, count(*) AS k, sum(tokens) AS s FROM {t} WHERE used <= {most} GROUP BY 1"
    return f"""WITH {source}, pr AS ({run("p", order_p)}), rr AS ({run("r", order_r)}), pb AS ({body("pr", "Primary Results", 900)}), rb AS ({body("rr", "Related Context", 450)}),
    o AS (SELECT query_id, count(*) AS n FROM (SELECT query_id FROM p UNION ALL SELECT query_id FROM r) GROUP BY 1), j AS (SELECT o.query_id, o.n, pb.b AS p, rb.b AS r, coalesce(pb.k, 0) AS pk, coalesce(rb.k, 0) AS rk, coalesce(pb.s, 0) + coalesce(rb.s, 0) AS s, {"coalesce(g.t, '')" if graph else "''"} AS t FROM o LEFT JOIN pb USING (query_id) LEFT JOIN rb USING (query_id) {graph})
    SELECT query_id, sha256(concat_ws(chr(10), p, r, CASE WHEN t <> '' AND ceil(length(t) / 4.0) <= 150 THEN '## Dependency Graph' || chr(10) || chr(10) || t END)) AS digest, pk AS n_primary, rk AS n_related, t <> '' AND ceil(length(t) / 4.0) <= 150 AS has_graph,
    CAST(s + CASE WHEN ceil(length(t) / 4.0) <= 150 THEN ceil(length(t) / 4.0) ELSE 0 END AS BIGINT) AS tokens, pk + rk < n OR ceil(length(t) / 4.0) > 150 AS truncated FROM j"""


def _digest(made):
    return made.select("query_id", F.sha2("content", 256).alias("digest"), "n_primary", "n_related", "has_graph", c("tokens").cast("bigint").alias("tokens"), "truncated")


_FENCED = "chr(10) || '```' || chr(10) || text || chr(10) || '```'"


@registry.query(
    "assemble_context",
    _context_sql(
        f"""{_RUNS}, txt AS (SELECT r.query_id, r.item_id AS id, r.rank, d.text FROM runs r JOIN documents d ON d.doc_id = r.item_id WHERE d.text IS NOT NULL),
    p AS (SELECT query_id, rank, '### (unnamed chunk)' || {_FENCED} AS f FROM txt WHERE rank <= 10), r AS (SELECT query_id, rank, '### unknown [related, distance=' || rank || ']' || {_FENCED} AS f FROM txt WHERE rank > 10)""",
        "rank",
        "rank",
    ),
)
def assemble_context(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(c("doc_id").alias("item_id"), "text")
    rows = _runs(spark, d).join(docs, "item_id").select("query_id", c("item_id").alias("id"), "text", "rank")
    primary = rows.where("rank <= 10").withColumn("score", -c("rank"))
    return _digest(B.assemble(primary, rows.where("rank > 10").withColumn("distance", c("rank")), max_tokens=2000, reserve=500))


_LINES = "CASE WHEN start_line IS NOT NULL AND end_line IS NOT NULL THEN ' [L' || start_line || '-' || end_line || ']' ELSE '' END"


@registry.query(
    "assemble_code_context",
    _context_sql(
        f"""fs AS (SELECT DISTINCT file_path AS query_id FROM scanned_files WHERE file_id % 50 = 0 AND file_path <> ''),
    ed AS (SELECT DISTINCT source AS query_id, target FROM graph_edges JOIN fs ON source = query_id WHERE type = 'imports' AND target <> '' AND target <> source),
    ch AS (SELECT DISTINCT id, content AS text, nl_summary, file_path, start_line, end_line, metadata.chunk_type AS kind, metadata.name AS name FROM chunks WHERE content IS NOT NULL AND file_path IS NOT NULL),
    p AS (SELECT query_id, -coalesce(start_line, 0) AS score, id, CASE WHEN name <> '' THEN '### ' || name || ' (' || coalesce(kind, 'unknown') || ')' ELSE '### (unnamed chunk)' END || chr(10) || 'File: ' || file_path || {_LINES} || CASE WHEN nl_summary <> '' THEN chr(10) || nl_summary ELSE '' END || {_FENCED} AS f FROM fs JOIN ch ON file_path = query_id),
    r AS (SELECT query_id, id, '### ' || coalesce(name, 'unknown') || ' [imports, distance=1]' || chr(10) || 'File: ' || file_path || CASE WHEN nl_summary <> '' THEN chr(10) || nl_summary ELSE '' END || {_FENCED} AS f FROM ed JOIN ch ON file_path = target),
    g AS (SELECT query_id, 'Nodes: ' || query_id || ', ' || string_agg(target, ', ' ORDER BY target) || chr(10) || string_agg(query_id || ' --[imports]--> ' || target, chr(10) ORDER BY target) AS t FROM ed GROUP BY 1)""",
        "score DESC, id",
        "id",
        "LEFT JOIN g USING (query_id)",
    ),
)
def assemble_code_context(spark, d):
    """Every file whose id is divisible by 50: its chunks, those of the files that it imports, and the graph between them."""
    asked = table(spark, d, "scanned_files").where("file_id % 50 = 0 and file_path <> ''").select(c("file_path").alias("query_id")).distinct()
    edges = table(spark, d, "graph_edges").where("type = 'imports' and target <> '' and target <> source").select(c("source").alias("query_id"), "target").distinct().join(asked, "query_id", "left_semi")
    chunks = table(spark, d, "chunks").where("content is not null and file_path is not null").select("id", c("content").alias("text"), c("nl_summary").alias("summary"), "file_path", "start_line", "end_line", c("metadata.chunk_type").alias("chunk_type"), c("metadata.name").alias("name")).distinct()
    primary = chunks.join(asked, c("file_path") == c("query_id")).withColumn("score", -F.coalesce("start_line", F.lit(0)))
    related = chunks.join(edges, c("file_path") == c("target")).withColumns({"distance": F.lit(1), "relationship": F.lit("imports")})
    # the imports of one file are bounded by its text
    targets = F.array_sort(F.collect_list("target"))
    graph = edges.groupBy("query_id").agg(targets.alias("targets")).select("query_id", F.concat(F.array("query_id"), "targets").alias("nodes"), F.transform("targets", lambda t: F.struct(c("query_id").alias("source"), t.alias("target"), F.lit("imports").alias("type"))).alias("edges"))
    return _digest(B.assemble(primary, related, graph, max_tokens=2000, reserve=500))


@registry.query(
    "context_recall",
    """WITH e AS (SELECT DISTINCT id AS query_id, concat_ws(' ', title, description) AS text, unnest(tags) AS info FROM backlog_items WHERE id IS NOT NULL)
    SELECT query_id, round(avg(CASE WHEN contains(lower(text), lower(info)) THEN 1.0 ELSE 0.0 END), 6) AS context_recall FROM e WHERE info IS NOT NULL GROUP BY 1
    UNION ALL SELECT DISTINCT id, NULL FROM backlog_items WHERE id IS NOT NULL AND id NOT IN (SELECT query_id FROM e WHERE info IS NOT NULL)""",
)
def context_recall(spark, d):
    """Tags of work items as expected information, their texts as contexts."""
    items = table(spark, d, "backlog_items").where("id is not null").select(c("id").alias("query_id"), F.concat_ws(" ", "title", "description").alias("text"), "tags").distinct()
    return E.context_recall(items.select("query_id", "text", F.explode("tags").alias("info")).distinct(), items.select("query_id", "text").distinct()).select("query_id", F.round("context_recall", 6).alias("context_recall"))


_LEVELS = _RUNS + """, bud AS (SELECT ql AS strategy, b AS budget, avg(CASE WHEN f <= b THEN 1 / f ELSE 0 END) AS mrr FROM (SELECT r.query_id, max(r.ql) AS ql, max(s.f) AS f FROM runs r JOIN s USING (query_id) GROUP BY 1), (SELECT unnest([1, 2, 3, 5, 10, 20]) AS b) GROUP BY 1, 2)"""


def _levels(spark, d):
    """Mean reciprocal rank by label and depth of the list, as budgets."""
    labels = table(spark, d, "embeddings").select(c("vec_id").alias("query_id"), c("label").alias("strategy"))
    first = E.ir_metrics(_runs(spark, d), _qrels(spark, d)).select("query_id", "mrr").join(labels, "query_id")
    each = first.withColumn("budget", F.explode(F.array(*(F.lit(b) for b in (1, 2, 3, 5, 10, 20)))))
    reached = F.when((c("mrr") > 0) & (1 / F.when(c("mrr") > 0, c("mrr")) <= c("budget") + 1e-9), c("mrr")).otherwise(0.0)
    return each.groupBy("strategy", "budget").agg(F.avg(reached).alias("mrr"))


@registry.query("budget_metrics", f"WITH {_LEVELS} SELECT strategy, budget, round(mrr, 6) AS mrr FROM bud")
def budget_metrics(spark, d):
    return _rounded(_levels(spark, d), ["strategy", "budget"], ["mrr"])


_SHARE = "cur AS (SELECT strategy, budget, mrr, CASE WHEN max(mrr) OVER (PARTITION BY strategy) > 0 THEN mrr / max(mrr) OVER (PARTITION BY strategy) ELSE 0 END AS share FROM bud)"


@registry.query("quality_curve", f"WITH {_LEVELS}, {_SHARE} SELECT strategy, budget, round(share, 6) AS share, share >= 0.9 AS reached FROM cur")
def quality_curve(spark, d):
    return E.quality_curve(_levels(spark, d)).select("strategy", "budget", F.round("share", 6).alias("share"), "reached")


_AUC = "st AS (SELECT strategy, budget, mrr, lag(budget) OVER w AS pb, lag(mrr) OVER w AS pm FROM bud WINDOW w AS (PARTITION BY strategy ORDER BY budget)), au AS (SELECT strategy, sum((budget - pb) * (mrr + pm) / 2) / (max(budget) - min(budget)) AS auc FROM st GROUP BY 1)"
_EFF = f"{_LEVELS}, {_SHARE}, {_AUC}, ef AS (SELECT strategy, min(budget) FILTER (share >= 0.9 AND mrr > 0) AS t, max(mrr) AS max_mrr FROM cur GROUP BY 1)"


@registry.query("efficiency_threshold", f"WITH {_EFF} SELECT strategy, t AS tokens_to_threshold, round(max_mrr, 6) AS max_mrr FROM ef")
def efficiency_threshold(spark, d):
    return E.efficiency(_levels(spark, d)).select("strategy", "tokens_to_threshold", F.round("max_mrr", 6).alias("max_mrr"))


@registry.query("quality_auc", f"WITH {_LEVELS}, {_AUC} SELECT strategy, round(auc, 6) AS auc FROM au")
def quality_auc(spark, d):
    return _rounded(E.auc(_levels(spark, d)), ["strategy"], ["auc"])


@registry.query("rank_strategies", f"WITH {_EFF} SELECT strategy, CAST(row_number() OVER (ORDER BY t ASC NULLS LAST, round(max_mrr, 9) DESC, strategy) AS INT) AS rank FROM ef")
def rank_strategies(spark, d):
    return E.efficiency(_levels(spark, d).withColumn("mrr", F.round("mrr", 9))).select("strategy", "rank")


@registry.query(
    "metric_regression",
    f"""WITH {_RUNS}, cu AS (UNPIVOT (SELECT {", ".join(f"avg({x}) AS {x}" for x in _COLS)} FROM m) ON {", ".join(_COLS)} INTO NAME metric VALUE value),
    ba AS (UNPIVOT (SELECT {", ".join(f"avg({x}) AS {x}" for x in _COLS)} FROM m WHERE label < 5) ON {", ".join(_COLS)} INTO NAME metric VALUE value)
    SELECT metric, round(ba.value, 6) AS baseline, round(cu.value, 6) AS current, round(CASE WHEN ba.value = 0 THEN 0 ELSE (cu.value - ba.value) / ba.value * 100 END, 4) AS delta_percent, CASE WHEN ba.value = 0 THEN false ELSE (cu.value - ba.value) / ba.value * 100 < -5 END AS regressed FROM ba JOIN cu USING (metric)""",
)
def metric_regression(spark, d):
    """All queries against those of the first five labels."""
    labels = table(spark, d, "embeddings").select(c("vec_id").alias("query_id"), "label")
    metrics = _metrics(spark, d).join(labels, "query_id")
    long = lambda rows: rows.agg(*(F.avg(x).alias(x) for x in _COLS)).unpivot([], _COLS, "metric", "value")
    found = E.regressions(long(metrics), long(metrics.where("label < 5")))
    return found.select("metric", F.round("baseline", 6).alias("baseline"), F.round("current", 6).alias("current"), F.round("delta_percent", 4).alias("delta_percent"), "regressed")


_PAIRS = "pr AS (SELECT DISTINCT id, language, nl_summary AS a, coalesce(metadata.name, '') AS b FROM chunks WHERE nl_summary IS NOT NULL)"


@registry.query(
    "repobench_em_es",
    rf"WITH {_PAIRS} SELECT lower(language) AS language, count(*) AS n, round(avg(CASE WHEN trim(regexp_replace(a, '\s+', ' ', 'g')) = trim(regexp_replace(b, '\s+', ' ', 'g')) THEN 1.0 ELSE 0.0 END), 6) AS em, round(avg(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END), 6) AS es FROM pr GROUP BY ROLLUP (lower(language)) HAVING grouping(lower(language)) = 1 OR lower(language) IS NOT NULL",
)
def repobench_em_es(spark, d):
    pairs = table(spark, d, "chunks").where("nl_summary is not null").select("id", "language", c("nl_summary").alias("a"), F.coalesce("metadata.name", F.lit("")).alias("b")).distinct()
    scores = pairs.select(F.lower("language").alias("language"), F.when(T.exact_match(c("a"), c("b")), 1.0).otherwise(0.0).alias("m"), T.edit_similarity(c("a"), c("b")).alias("s"))
    rolled = scores.rollup("language").agg(F.grouping("language").alias("g"), F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("em"), F.round(F.avg("s"), 6).alias("es"))
    return rolled.where("g = 1 or language is not null").drop("g")


@registry.query("query_difficulty", f"WITH {_RUNS} SELECT query_id, n_rel, CASE WHEN n_rel = 1 THEN 'easy' WHEN n_rel <= 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM sizes")
def query_difficulty(spark, d):
    sizes = _qrels(spark, d).groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return sizes.withColumn("difficulty", F.when(c("n_rel") == 1, "easy").when(c("n_rel") <= 3, "medium").otherwise("hard"))
