"""Chunking, Markdown, work items, manifests, benchmarks' queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import backlog as BL
from lodestrata.operators import chunking as C
from lodestrata.operators import incremental as I
from lodestrata.operators import questions as Q
from lodestrata.plans.registry import Registry
from lodestrata.sources import manifests as M
from lodestrata.sources.tables import table

registry = Registry()
c = F.col


def _files(spark, d):
    return table(spark, d, "scanned_files").where("content is not null").select("file_path", "content").distinct()


_JS, _PY, _GO, _JAVA = (C.DECLARATIONS[k] for k in ("javascript", "python", "go", "java"))
_DECL = rf"""fl AS (SELECT DISTINCT file_path, content, CASE WHEN regexp_matches(lower(file_path), '\.(js|jsx|mjs|cjs|ts|mts|cts|tsx)$') THEN 'js' WHEN regexp_matches(lower(file_path), '\.pyw?$') THEN 'py' WHEN regexp_matches(lower(file_path), '\.go$') THEN 'go' WHEN regexp_matches(lower(file_path), '\.java$') THEN 'java' END AS lang FROM scanned_files WHERE content IS NOT NULL),
 ln AS (SELECT file_path, content, lang, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line, len(string_split(content, chr(10))) AS total FROM fl WHERE lang IS NOT NULL),
 tx AS (SELECT *, string_split(content, chr(10))[line] AS text FROM ln),
 de AS (SELECT file_path, content, line, total, CASE lang WHEN 'js' THEN regexp_extract(text, '{_JS}', 1) WHEN 'py' THEN regexp_extract(text, '{_PY}', 1) WHEN 'go' THEN regexp_extract(text, '{_GO}', 1) ELSE regexp_extract(text, '{_JAVA}', 1) END AS name FROM tx),
 rg AS (SELECT file_path, content, name, line AS start_line, coalesce(lead(line) OVER (PARTITION BY file_path, content ORDER BY line) - 1, total) AS end_line FROM de WHERE name <> '')"""


def _code(spark, d):
    return _files(spark, d).withColumn("language", T.detect_language(c("file_path"))).where("language is not null")


@registry.query("extract_declarations", f"WITH {_DECL} SELECT file_path, name, CAST(start_line AS INT) AS line FROM rg")
def extract_declarations(spark, d):
    return _code(spark, d).select("file_path", F.explode(C.declarations(c("content"), c("language"))).alias("x")).select("file_path", "x.name", "x.line")


#: files of the languages that the tables lack, with the names that they declare; X is a name
_FORMS = {
    "rs": ("use std::fmt;\npub struct X { a: u8 }\nimpl fmt::Display for X {\n    fn fmt(&self) {}\n}\npub async fn run_X() {}\nstatic mut N_X: u8 = 0;", ["X", "X", "run_X", "N_X"]),
    "cs": ("using System;\nnamespace N.X;\npublic sealed class X : IDisposable {\n        int a = 0;\n}\ninternal record struct R_X(int A);", ["N.X", "X", "R_X"]),
    "c": ("#include <a.h>\nstruct X { int a; };\nstatic const char *name_X(int a) {\n    return 0;\n}\nint count_X = 0;", ["X", "name_X", "count_X"]),
    "cpp": ("#include <a>\nnamespace ns_X {\ntemplate <typename T> class X : public B {\n};\nstd::vector<int> X::list(int a) {\n    return {};\n}\n}", ["ns_X", "X", "X::list"]),
    "rb": ("require 'a'\nmodule M_X\nend\nclass X < Base\n  def inner; end\nend\ndef self.make_X?(a)\nend", ["M_X", "X", "make_X?"]),
    "php": ("<?php\nuse A;\ninterface I_X {}\nfinal class X implements I_X {\n    public function f() {}\n}\nfunction go_X() {}", ["I_X", "X", "go_X"]),
}


def _values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


@registry.query(
    "declarations_polyglot",
    f"""WITH n AS (SELECT DISTINCT 'T' || regexp_replace(metadata.name, '[^A-Za-z0-9_]', '', 'g') AS x FROM chunks WHERE metadata.name IS NOT NULL), f(ext, pos, form) AS (VALUES {_values((e, i, x) for e, (_, xs) in _FORMS.items() for i, x in enumerate(xs))})
    SELECT x || '.' || ext AS file_path, CAST(pos AS INT) AS pos, replace(form, 'X', x) AS name FROM n, f""",
)
def declarations_polyglot(spark, d):
    """Declarations of generated files of six more languages; the SQL states the names that were put in."""
    names = table(spark, d, "chunks").where("metadata.name is not null").select(F.concat(F.lit("T"), F.regexp_replace("metadata.name", "[^A-Za-z0-9_]", "")).alias("x")).distinct()
    forms = F.explode(F.array(*(F.struct(F.lit(e).alias("ext"), F.lit(t).alias("form")) for e, (t, _) in _FORMS.items())))
    files = names.select("x", forms.alias("f")).select(F.concat_ws(".", "x", "f.ext").alias("file_path"), F.replace(c("f.form"), F.lit("X"), c("x")).alias("content"))
    return files.select("file_path", F.posexplode(C.declarations(c("content"), T.detect_language(c("file_path")))).alias("pos", "x")).select("file_path", "pos", "x.name")


@registry.query("decl_regions", f"WITH {_DECL} SELECT file_path, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM rg")
def decl_regions(spark, d):
    return _code(spark, d).select("file_path", F.explode(C.regions(c("content"), c("language"))).alias("x")).select("file_path", "x.*")


_KIND = "CASE " + " ".join(rf"WHEN regexp_matches(t, '(^|\n){p}') THEN '{k}'" for k, p in T.KIND_PATTERNS) + " ELSE 'module' END"


@registry.query(
    "chunk_code",
    rf"""WITH {_DECL}, fst AS (SELECT file_path, content, min(start_line) AS f FROM rg GROUP BY 1, 2),
    parts AS (SELECT file_path, content, name, start_line, end_line, false AS whole FROM rg
     UNION ALL SELECT file_path, content, NULL, 1, f - 1, false FROM fst WHERE f > 1
     UNION ALL SELECT l.file_path, l.content, NULL, 1, l.total, true FROM (SELECT DISTINCT file_path, content, total FROM ln) l LEFT JOIN fst USING (file_path, content) WHERE f IS NULL),
    tx2 AS (SELECT file_path, name, start_line, end_line, whole, regexp_replace(array_to_string(string_split(content, chr(10))[start_line:end_line], chr(10)), '\n+\z', '') AS content FROM parts)
    SELECT file_path, name, CASE WHEN whole THEN 'module' WHEN name IS NULL THEN 'import_block' ELSE {_KIND} END AS chunk_type, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, sha256(file_path || CAST(start_line AS VARCHAR) || content) AS id
    FROM (SELECT *, regexp_replace(content, '^\s+', '') AS t FROM tx2) WHERE regexp_replace(content, '\s+', '', 'g') <> ''""",
)
def chunk_code(spark, d):
    return C.chunk_code(_files(spark, d)).drop("content")


@registry.query("python_declarations")
def python_declarations(spark, d):
    return C.python_declarations(_files(spark, d).where(c("file_path").rlike(r"(?i)\.py$")))


@registry.query("split_oversize")
def split_oversize(spark, d):
    rows = _files(spark, d).withColumn("start_line", F.lit(1))
    return C.split_oversize(rows, 128, keep=["file_path"]).select("file_path", "start_line", "end_line", F.length("content").alias("chars"))


_MD = r"""dx AS (SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL), dl AS (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM dx),
 hd AS (SELECT doc_id, ls, line, regexp_extract(ls[line], '^(#{1,6})\s+(.+?)\s*$', 2) AS heading, length(regexp_extract(ls[line], '^(#{1,6})\s+(.+?)\s*$', 1)) AS level FROM dl),
 hs AS (SELECT * FROM hd WHERE level > 0 UNION ALL SELECT doc_id, ls, line, '', 0 FROM hd WHERE line = 1 AND level = 0),
 sc AS (SELECT doc_id, heading, level, line AS start_line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, len(ls)) AS end_line FROM hs)"""


@registry.query("md_sections", f"WITH {_MD} SELECT doc_id, heading, CAST(level AS INT) AS level, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM sc")
def md_sections(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(C.sections(c("text"))).alias("s")).select("doc_id", "s.*")


@registry.query(
    "md_code_blocks",
    rf"WITH {_MD}, fe AS (SELECT doc_id, ls, line, ls[line] AS t, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nx FROM dl WHERE regexp_matches(ls[line], '^\s*```')) SELECT doc_id, regexp_extract(t, '```\s*(\w*)', 1) AS language, CAST(line AS INT) AS start_line, CAST(nx AS INT) AS end_line, sha256(array_to_string(ls[line + 1:nx - 1], chr(10))) AS digest FROM fe WHERE n % 2 = 1 AND nx IS NOT NULL",
)
def md_code_blocks(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(C.code_blocks(c("text"))).alias("b"))
    return rows.select("doc_id", "b.language", "b.start_line", "b.end_line", F.sha2("b.code", 256).alias("digest"))


_FM = r"'---' || chr(10) || 'title: \"' || source || ' page\"' || chr(10) || 'tags: [' || source || ', ' || repo_name || ']' || chr(10) || 'aliases:' || chr(10) || '  - ' || doc_path || chr(10) || '  - x' || chr(10) || '---' || chr(10) || coalesce(text, '')".replace('\\"', '"')


def _with_front(spark, d):
    head = F.concat(F.lit('---\ntitle: "'), c("source"), F.lit(' page"\ntags: ['), c("source"), F.lit(", "), c("repo_name"), F.lit("]\naliases:\n  - "), c("doc_path"), F.lit("\n  - x\n---\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", "doc_path", head.alias("t"))


@registry.query(
    "md_frontmatter",
    rf"WITH f AS (SELECT doc_id, regexp_extract(replace(t, chr(13), ''), '(?s)^---\n(.*?)\n---\n', 1) AS b FROM (SELECT doc_id, {_FM} AS t FROM documents)) SELECT doc_id, trim(regexp_extract(b, '(?m)^title:[ \t]*([^\n\[]+)$', 1), '\"') AS title, array_to_string(list_transform(string_split(regexp_extract(b, '(?m)^tags:[ \t]*\[([^\]\n]*)\]', 1), ','), lambda x: trim(x)), ',') AS tags, array_to_string(regexp_extract_all(regexp_extract(b, '(?s)aliases:\n(.*)$', 1), '-[ \t]+([^\n]*)', 1), ',') AS aliases, CAST(len(string_split(b, chr(10))) + 3 AS INT) AS body_line FROM f".replace('\\"', '"'),
)
def md_frontmatter(spark, d):
    return _with_front(spark, d).select("doc_id", C.frontmatter(c("t")).alias("f")).select("doc_id", "f.title", F.array_join("f.tags", ",").alias("tags"), F.array_join("f.aliases", ",").alias("aliases"), "f.body_line")


@registry.query("md_chunks")
def md_chunks(spark, d):
    made = C.chunk_markdown(_with_front(spark, d), "doc_path", "t", 256)
    return made.select("file_path", "name", "level", "start_line", "end_line", F.array_join("links", ",").alias("links"), F.array_join("tags", ",").alias("tags"), "id")


# ---- work items ------------------------------------------------------------------------------

_ITEMS = "it AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM backlog_items) WHERE rn = 1)"


def _items(spark, d):
    return table(spark, d, "backlog_items").drop("metadata").dropDuplicates(["id"])


@registry.query("backlog_query", f"WITH {_ITEMS} SELECT id, title, updated_at FROM it WHERE type IN ('bug', 'task') AND lower(state) IN ('closed', 'resolved', 'active', 'new') AND contains(lower(concat_ws(' ', title, description)), 'index') ORDER BY updated_at DESC, id LIMIT 25")
def backlog_query(spark, d):
    return BL.query(_items(spark, d), types=["bug", "task"], states=["Closed", "resolved", "Active", "new"], text="Index", limit=25).select("id", "title", "updated_at")


@registry.query("backlog_tags", f"WITH {_ITEMS} SELECT id FROM it WHERE list_contains(tags, 'route') OR list_contains(tags, 'token')")
def backlog_tags(spark, d):
    items = _items(spark, d)
    return BL.query(items, tags=["route"]).select("id").union(BL.query(items, tags=["token"]).select("id")).distinct()


_TYPE_SQL = "CASE " + " ".join("WHEN t IN (" + ", ".join(f"'{w}'" for w in ws.split()) + f") THEN '{k}'" for k, ws in BL.TYPES.items()) + " ELSE 'task' END"


@registry.query("backlog_normalize", rf"WITH {_ITEMS} SELECT id, {_TYPE_SQL} AS type, tags FROM (SELECT id, regexp_replace(lower(trim(type)), '[\s-]+', '_', 'g') AS t, array_to_string(list_filter(list_transform(string_split(array_to_string(tags, ' ; '), ';'), lambda x: trim(x)), lambda x: x <> ''), ',') AS tags FROM it)")
def backlog_normalize(spark, d):
    tags = F.array_join(BL.split_tags(F.array_join("tags", " ; ")), ",")
    return _items(spark, d).select("id", BL.common_type(c("type")).alias("type"), tags.alias("tags"))


_BODY = r"concat_ws(chr(10), '# ' || title, 'Type: ' || type, 'State: ' || nullif(state, ''), 'Tags: ' || nullif(array_to_string(tags, ', '), ''), regexp_replace(description, '<[^>]+>', '', 'g'))"


@registry.query("backlog_chunks", f"WITH {_ITEMS} SELECT id, 'backlog:' || replace(external_id, '#', '-') AS chunk_id, sha256({_BODY}) AS digest FROM it")
def backlog_chunks(spark, d):
    return BL.markdown(_items(spark, d)).select("id", "chunk_id", F.sha2("content", 256).alias("digest"))


_DIGEST = "sha256(concat_ws(chr(1), " + ", ".join(f"coalesce({x}, '')" for x in ("id", "title", "description", "type", "state", "assigned_to", "array_to_string(tags, ',')")) + "))"


@registry.query(
    "backlog_changes",
    f"WITH {_ITEMS}, n AS (SELECT id, {_DIGEST} AS h FROM it), o AS (SELECT id, {_DIGEST.replace('coalesce(state', 'coalesce(lower(state)')} AS h FROM it WHERE created_at < TIMESTAMP '2025-11-01') SELECT id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.h = o.h THEN 'unchanged' ELSE 'modified' END AS change FROM n LEFT JOIN o USING (id)",
)
def backlog_changes(spark, d):
    """Against a snapshot of November 2025 that held states in lower case."""
    items = _items(spark, d)
    before = items.where(c("created_at").cast("timestamp_ntz") < F.lit("2025-11-01").cast("timestamp_ntz")).withColumn("state", F.lower("state"))
    return I.detect_changes(BL.digest(items), BL.digest(before), "id", "digest")


_LINKS = r"rf AS (SELECT DISTINCT doc_id AS chunk_id, 'AB#' || unnest(regexp_extract_all(t, 'AB#(\d+)', 1)) AS external_id FROM (SELECT doc_id, coalesce(text, '') || ' AB#' || (doc_id % 977) || ' AB#' || (doc_id % 13) AS t FROM documents)), lk AS (SELECT DISTINCT chunk_id, id AS item_id FROM rf JOIN (SELECT DISTINCT external_id, id FROM backlog_items) USING (external_id))"


def _links(spark, d):
    """Documents name no items, so each is given two references by its number."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" AB#"), (c("doc_id") % 977).cast("string"), F.lit(" AB#"), (c("doc_id") % 13).cast("string"))
    return BL.links(table(spark, d, "documents").select(c("doc_id").alias("chunk_id"), text.alias("text")), table(spark, d, "backlog_items"))


@registry.query("link_backlog", f"WITH {_LINKS} SELECT chunk_id, item_id FROM lk")
def link_backlog(spark, d):
    return _links(spark, d)


@registry.query("backlog_coverage", f"WITH {_LINKS}, al AS (SELECT DISTINCT id FROM backlog_items), s AS (SELECT count(*) AS total, count(*) FILTER (id IN (SELECT item_id FROM lk)) AS linked FROM al) SELECT total, linked, total - linked AS unlinked, round(linked / total * 100, 2) AS percent FROM s")
def backlog_coverage(spark, d):
    return BL.coverage(table(spark, d, "backlog_items"), _links(spark, d))


@registry.query("backlog_linked", f"WITH {_LINKS} SELECT DISTINCT id FROM backlog_items WHERE id IN (SELECT item_id FROM lk)")
def backlog_linked(spark, d):
    return table(spark, d, "backlog_items").select("id").distinct().join(_links(spark, d).select(c("item_id").alias("id")), "id", "left_semi")


@registry.query("backlog_unlinked", f"WITH {_LINKS} SELECT DISTINCT id FROM backlog_items WHERE id NOT IN (SELECT item_id FROM lk)")
def backlog_unlinked(spark, d):
    return table(spark, d, "backlog_items").select("id").distinct().join(_links(spark, d).select(c("item_id").alias("id")), "id", "left_anti")


@registry.query("backlog_graph", r"SELECT DISTINCT 'backlog:' || id AS source, p AS target FROM (SELECT id, trim(unnest(linked_code_paths)) AS p FROM backlog_items) WHERE p IN (SELECT file_path FROM scanned_files)")
def backlog_graph(spark, d):
    paths = table(spark, d, "backlog_items").select(F.concat(F.lit("backlog:"), "id").alias("source"), F.explode("linked_code_paths").alias("p")).select("source", F.trim("p").alias("target")).distinct()
    return paths.join(table(spark, d, "scanned_files").select(c("file_path").alias("target")), "target", "left_semi").select("source", "target")


# ---- manifests ---------------------------------------------------------------------------------

_MAN = "mf AS (SELECT repo_name, coalesce(package_name, repo_name) AS name, coalesce(list_sort(list_distinct(list_filter(dependencies, lambda x: x IS NOT NULL))), []) AS deps, coalesce(list_sort(list_distinct(list_filter(dev_dependencies, lambda x: x IS NOT NULL))), []) AS dev FROM manifests)"
_MAN_OUT = "SELECT repo_name, name AS package_name, array_to_string(deps, ',') AS dependencies, array_to_string({dev}, ',') AS dev_dependencies FROM mf"


def _manifests(spark, d):
    clean = lambda x: F.array_sort(F.array_distinct(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull())))
    return table(spark, d, "manifests").select("repo_name", F.coalesce("package_name", "repo_name").alias("name"), clean(c("dependencies")).alias("deps"), clean(c("dev_dependencies")).alias("dev"))


def _flat(rows):
    return rows.select("repo_name", "package_name", F.array_join(F.array_sort("dependencies"), ",").alias("dependencies"), F.array_join(F.array_sort("dev_dependencies"), ",").alias("dev_dependencies"))


@registry.query("parse_package_json", f"WITH {_MAN} " + _MAN_OUT.format(dev="dev"))
def parse_package_json(spark, d):
    """The manifests written as package.json and read back."""
    versions = lambda a: F.map_from_arrays(a, F.transform(a, lambda _: F.lit("^1.0.0")))
    text = F.to_json(F.struct(c("name"), versions(c("deps")).alias("dependencies"), versions(c("dev")).alias("devDependencies")))
    return _flat(M.package_json(_manifests(spark, d).select("repo_name", text.alias("content"))))


@registry.query("parse_go_mod", f"WITH {_MAN} " + _MAN_OUT.format(dev="[]"))
def parse_go_mod(spark, d):
    block = F.array_join(F.transform("deps", lambda x: F.concat(F.lit("\t"), x, F.lit(" v1.2.3 // indirect"))), "\n")
    text = F.concat(F.lit("module "), c("name"), F.lit("\n\ngo 1.22\n\nrequire (\n"), block, F.lit("\n)\n"))
    return _flat(M.go_mod(_manifests(spark, d).select("repo_name", text.alias("content"))))


@registry.query("parse_cargo", f"WITH {_MAN} " + _MAN_OUT.format(dev="dev"))
def parse_cargo(spark, d):
    lines = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit('"'), x, F.lit('" = "1.0"'))), "\n")
    text = F.concat(F.lit('[package]\nname = "'), c("name"), F.lit('"\nversion = "0.1.0"\n\n[dependencies]\n'), lines(c("deps")), F.lit("\n\n[dev-dependencies]\n"), lines(c("dev")), F.lit("\n[profile.release]\nlto = true\n"))
    return _flat(M.cargo_toml(_manifests(spark, d).select("repo_name", text.alias("content"))))


# ---- queries of benchmarks ---------------------------------------------------------------------

_ENT = "en AS (SELECT DISTINCT id, metadata.name AS name, metadata.chunk_type AS kind, nl_summary, file_path FROM chunks)"


def _entities(spark, d):
    return table(spark, d, "chunks").select("id", c("metadata.name").alias("name"), c("metadata.chunk_type").alias("kind"), "nl_summary", "file_path").distinct()


@registry.query("scan_entities", "SELECT DISTINCT id, json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.name') AS name, coalesce(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.chunkType'), chunk_type) AS kind FROM vector_rows")
def scan_entities(spark, d):
    """Entities of the stored rows; metadata that is no JSON counts as absent."""
    meta = F.from_json("metadata", "name string, chunkType string")
    return table(spark, d, "vector_rows").select("id", meta.alias("m"), "chunk_type").select("id", "m.name", F.coalesce("m.chunkType", "chunk_type").alias("kind")).distinct()


@registry.query(
    "generate_queries",
    f"WITH {_ENT} SELECT DISTINCT 'name' AS query_type, 'where is ' || name || ' defined' AS query FROM en WHERE kind IN ('function', 'class', 'interface') AND name IS NOT NULL UNION SELECT 'summary', nl_summary FROM en WHERE length(nl_summary) > 20 UNION SELECT 'callers', 'who calls ' || target FROM graph_edges WHERE type = 'calls' AND target <> ''",
)
def generate_queries(spark, d):
    en = _entities(spark, d)
    names = en.where(c("kind").isin("function", "class", "interface") & c("name").isNotNull()).select(F.lit("name").alias("query_type"), F.concat(F.lit("where is "), "name", F.lit(" defined")).alias("query"))
    told = en.where("length(nl_summary) > 20").select(F.lit("summary").alias("query_type"), c("nl_summary").alias("query"))
    calls = table(spark, d, "graph_edges").where("type = 'calls' and target <> ''").select(F.lit("callers").alias("query_type"), F.concat(F.lit("who calls "), "target").alias("query"))
    return names.unionByName(told).unionByName(calls).dropDuplicates(["query_type", "query"])


_ASKED = ("function", "method", "class", "interface", "type_alias", "module")


@registry.query(
    "benchmark_queries",
    rf"""WITH en AS (SELECT DISTINCT id, metadata.name AS name, coalesce(metadata.chunk_type, 'function') AS kind, nl_summary, file_path FROM chunks WHERE id IS NOT NULL),
    nm AS (SELECT * FROM en WHERE name <> ''), ky AS (SELECT id, name, kind, unnest([id, file_path || '#' || name, file_path]) AS node FROM nm),
    ts AS (SELECT regexp_replace(file_path, '(?s)^(.*?)\.(test|spec)\.', '\1.') AS file_path, id AS other FROM en WHERE regexp_matches(file_path, '\.(test|spec)\.[^.]+\z')),
    rl AS (SELECT 'callers' AS query_type, 'callers of ' || name AS query, id AS source_id, e.source AS expected_id FROM ky JOIN graph_edges e ON e.target = node WHERE e.type IN ('calls', 'references', 'imports') AND e.source IS NOT NULL
     UNION SELECT 'imports', 'imports of ' || name, id, e.target FROM ky JOIN graph_edges e ON e.source = node WHERE e.type = 'imports' AND e.target IS NOT NULL AND kind IN {_ASKED}
     UNION SELECT 'tests', 'tests for ' || name, id, other FROM nm JOIN ts USING (file_path) WHERE kind IN {_ASKED})
    SELECT * FROM rl UNION SELECT query_type, query, source_id, source_id FROM rl
    UNION SELECT 'name', name || ' ' || CASE kind WHEN 'type_alias' THEN 'type' ELSE kind END, id, id FROM nm WHERE kind IN {_ASKED}
    UNION SELECT 'summary', nl_summary, id, id FROM en WHERE length(nl_summary) > 20 AND kind IN {_ASKED}""",
)
def benchmark_queries(spark, d):
    """All five kinds, with a row for each expected id: those related and the entity itself.

    An entity has the edges of its id, of ``file#name`` and of its file; ids at their other ends stay as they are.
    """
    en = _entities(spark, d).where("id is not null").withColumn("kind", F.coalesce("kind", F.lit("function")))
    named, asked = en.where("name <> ''"), c("kind").isin(*_ASKED)
    keyed = named.select("id", "name", "kind", F.explode(F.array("id", F.concat("file_path", F.lit("#"), "name"), "file_path")).alias("node"))
    edges = table(spark, d, "graph_edges").select("source", "target", "type").where("source is not null and target is not null").distinct()
    tests = en.where(c("file_path").rlike(r"\.(test|spec)\.[^.]+\z")).select(F.regexp_replace("file_path", r"(?s)^(.*?)\.(test|spec)\.", "$1.").alias("file_path"), c("id").alias("other"))

    def of(kind, text, rows, expected):
        return rows.select(F.lit(kind).alias("query_type"), text.alias("query"), c("id").alias("source_id"), c(expected).alias("expected_id"))

    called = keyed.join(edges.where(c("type").isin("calls", "references", "imports")).withColumnRenamed("target", "node"), "node")
    imported = keyed.where(asked).join(edges.where("type = 'imports'").withColumnRenamed("source", "node"), "node")
    related = (
        of("callers", F.concat(F.lit("callers of "), "name"), called, "source")
        .unionByName(of("imports", F.concat(F.lit("imports of "), "name"), imported, "target"))
        .unionByName(of("tests", F.concat(F.lit("tests for "), "name"), named.where(asked).join(tests, "file_path"), "other"))
    )
    label = F.when(c("kind") == "type_alias", "type").otherwise(c("kind"))
    alone = of("name", F.concat_ws(" ", "name", label), named.where(asked), "id").unionByName(of("summary", c("nl_summary"), en.where(asked & (F.length("nl_summary") > 20)), "id"))
    expected = F.explode(F.array("source_id", "expected_id"))
    return related.select("query_type", "query", "source_id", expected.alias("expected_id")).unionByName(alone).distinct()


@registry.query(
    "template_queries",
    f"WITH {_ENT}, b AS (SELECT name, kind, count(DISTINCT id) AS n FROM en WHERE name IS NOT NULL GROUP BY 1, 2) SELECT replace(replace(t, 'NAME', name), 'KIND', coalesce(kind, 'code')) AS query, n AS expected, CASE WHEN n = 1 THEN 'easy' WHEN n <= 3 THEN 'medium' ELSE 'hard' END AS difficulty FROM b, (VALUES ('find the KIND NAME'), ('how does NAME work'), ('usage of NAME')) v(t)",
)
def template_queries(spark, d):
    counted = _entities(spark, d).where("name is not null").groupBy("name", "kind").agg(F.countDistinct("id").alias("expected"))
    forms = F.explode(F.array(*(F.lit(t) for t in ("find the KIND NAME", "how does NAME work", "usage of NAME"))))
    text = F.replace(F.replace(c("t"), F.lit("NAME"), c("name")), F.lit("KIND"), F.coalesce("kind", F.lit("code")))
    level = F.when(c("expected") == 1, "easy").when(c("expected") <= 3, "medium").otherwise("hard")
    return counted.withColumn("t", forms).select(text.alias("query"), "expected", level.alias("difficulty"))


def _question(template: str, expr: str, source: str, expected: str = "id") -> str:
    wording, category, difficulty = Q.TEMPLATES[template]
    return f"SELECT '{template}' AS template, {expr} AS query, '{category}' AS category, '{difficulty}' AS difficulty, {expected} AS expected_id FROM {source}"


_TEST = r"(\.(test|spec)\.[^./]+|_test\.[^./]+)$"
_QUESTIONS = " UNION ".join(
    [
        _question("function_lookup", "'Find the ' || name || ' function'", "n WHERE kind = 'function'"),
        _question("class_lookup", "'Show the ' || name || ' class'", "n WHERE kind = 'class'"),
        _question("interface_lookup", "'Where is the ' || name || ' interface defined'", "n WHERE kind = 'interface'"),
        _question("test_finding", "'Find the tests for ' || name", f"(SELECT n.name, unnest([n.id, t.id]) AS a FROM n JOIN e t ON regexp_matches(t.file_path, '{_TEST}') AND NOT regexp_matches(n.file_path, '{_TEST}') AND n.file_path = regexp_replace(t.file_path, '(\\.(test|spec)|_test)(\\.[^./]+)$', '\\3'))", "a"),
        _question("concept_module", "'How does the ' || module || ' module work'", "b"),
        _question("usage", "'What uses ' || name", "n JOIN l ON target = file_path || '#' || name", "source"),
        _question("relationship", "'How does ' || name || ' relate to ' || other || ' in the ' || module || ' module'", "(SELECT *, lead(name) OVER (PARTITION BY file_path ORDER BY name, id) AS other FROM n WHERE kind = 'class') WHERE other <> name AND module IS NOT NULL"),
        _question("method_lookup", "'Find the ' || name || ' method on ' || parent", "n WHERE kind = 'method' AND parent <> ''"),
        _question("error_investigation", "'How does the ' || module || ' module handle validation and errors'", "b WHERE careful OR module NOT IN (SELECT module FROM b WHERE careful)"),
        _question("import_chain", "'What does ' || regexp_extract(file_path, '([^/]+)$', 1) || ' import from other modules'", "(SELECT DISTINCT file_path, target FROM e JOIN l ON source = file_path WHERE type = 'imports')", "target"),
        _question("description_search", "nl_summary", "e WHERE nl_summary <> ''"),
        _question("service_overview", "'List all services in the ' || module || ' domain'", "b WHERE kind = 'class' AND contains(name, 'Service')"),
        _question("class_overview", "'List all classes in the ' || module || ' domain'", "b WHERE kind = 'class' AND module NOT IN (SELECT module FROM b WHERE kind = 'class' AND contains(name, 'Service'))"),
    ]
)


@registry.query(
    "template_questions",
    f"""WITH e AS (SELECT DISTINCT id, metadata.name AS name, metadata.chunk_type AS kind, metadata.repo_name AS module, file_path, metadata.parent_name AS parent, nl_summary FROM chunks WHERE id IS NOT NULL), n AS (SELECT * FROM e WHERE name <> ''),
    b AS (SELECT *, contains(lower(name), 'validate') OR regexp_matches(lower(coalesce(nl_summary, '')), 'validate|filter|parse') AS careful FROM n WHERE kind IN ('class', 'function') AND module IS NOT NULL), l AS (SELECT DISTINCT source, target, type FROM graph_edges WHERE source <> '' AND target <> '')
    SELECT DISTINCT * FROM ({_QUESTIONS})""",
)
def template_questions(spark, d):
    """All templates over all chunks; repositories are the modules."""
    rows = table(spark, d, "chunks").where("id is not null").select("id", c("metadata.name").alias("name"), c("metadata.chunk_type").alias("kind"), c("metadata.repo_name").alias("module"), "file_path", c("metadata.parent_name").alias("parent"), c("nl_summary").alias("description"))
    return Q.questions(rows, table(spark, d, "graph_edges"))


def _csn_lines(spark, d):
    """Documents as lines of a code search corpus, each with a line that does not parse."""
    part = F.when(c("doc_id") % 2 == 0, "test").otherwise("train")
    line = F.to_json(F.struct(c("repo_name").alias("repo"), c("doc_path").alias("path"), c("source").alias("func_name"), c("text").alias("docstring"), F.lower("lang").alias("language"), part.alias("partition")))
    return table(spark, d, "documents").select(F.explode(F.array(line, F.lit('{"repo": '))).alias("value"))


@registry.query("csn_load", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS partition, lower(lang) AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL AND repo_name IS NOT NULL AND doc_path IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2")
def csn_load(spark, d):
    from lodestrata.sources.benchmarks import csn_entries

    return csn_entries(_csn_lines(spark, d), least_tokens=0).groupBy("partition", "language").agg(F.count("*").alias("n"))


@registry.query(
    "repobench_load",
    "SELECT metadata.repo_name || ':' || file_path AS task_id, CAST(i - 1 AS INT) AS pos, names[i] AS code, names[i] = names[1] AS is_gold FROM (SELECT DISTINCT id, metadata, file_path, list_distinct(metadata.declarations) AS ld, metadata.declarations AS names, unnest(range(1, len(metadata.declarations) + 1)) AS i FROM chunks) WHERE metadata.repo_name IS NOT NULL AND file_path IS NOT NULL",
)
def repobench_load(spark, d):
    """Chunks as lines of a repository benchmark: declarations are the snippets, the first is the one wanted."""
    from lodestrata.sources.benchmarks import repobench_entries

    names = c("metadata.declarations")
    snippets = F.transform(names, lambda x: F.struct(c("file_path").alias("file_path"), x.alias("code")))
    rows = table(spark, d, "chunks").where(c("metadata.repo_name").isNotNull() & c("file_path").isNotNull()).distinct()
    line = F.to_json(F.struct(c("metadata.repo_name").alias("repo_name"), "file_path", F.lit("x").alias("context"), F.lit("y").alias("import_statement"), F.get(names, F.lit(0)).alias("gold_snippet_code"), snippets.alias("cross_file_context")))
    return repobench_entries(rows.select(line.alias("value"))).select("task_id", "pos", "code", "is_gold")


@registry.query("csn_dataset", r"SELECT lower(lang) || ':' || repo_name || ':' || doc_path || ':' || source AS entry_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS tokens FROM documents WHERE lang IS NOT NULL AND repo_name IS NOT NULL AND doc_path IS NOT NULL AND source IS NOT NULL AND doc_id % 2 = 0 AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 3")
def csn_dataset(spark, d):
    """Rows written as benchmark lines in JSON, read back with their schema, the partition ``test`` kept."""
    from lodestrata.sources.benchmarks import csn_entries

    return csn_entries(_csn_lines(spark, d), "test").select("entry_id", F.size("tokens").alias("tokens"))


@registry.query("repobench_tasks", "SELECT repo_name || ':' || file_path || ':' || id AS task_id, CAST(i - 1 AS INT) AS pos, names[i] AS snippet FROM (SELECT DISTINCT metadata.repo_name AS repo_name, file_path, id, metadata.declarations AS names, unnest(range(1, len(metadata.declarations) + 1)) AS i FROM chunks) WHERE repo_name IS NOT NULL AND file_path IS NOT NULL")
def repobench_tasks(spark, d):
    """One task per chunk, its declarations as the snippets to choose from."""
    rows = table(spark, d, "chunks").select(c("metadata.repo_name").alias("repo_name"), "file_path", "id", c("metadata.declarations").alias("names")).distinct()
    return rows.where("repo_name is not null and file_path is not null").select(F.concat_ws(":", "repo_name", "file_path", "id").alias("task_id"), F.posexplode("names").alias("pos", "snippet"))
