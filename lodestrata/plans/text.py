"""Text functions over whole tables: tokens, kinds, imports, references, query analysis, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.plans.registry import Registry
from lodestrata.sources.tables import table

registry = Registry()
c = F.col


def _lits(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _map_sql(values: dict) -> str:
    return f"MAP {{{', '.join(f'{_lits([k])}: {_lits([v])}' for k, v in values.items())}}}"


@registry.query("token_estimate", "SELECT DISTINCT id, CAST(ceil(length(content) / 4.0) AS INT) AS tokens FROM chunks WHERE content IS NOT NULL")
def token_estimate(spark, d):
    return table(spark, d, "chunks").where("content is not null").select("id", T.token_estimate(c("content")).alias("tokens")).distinct()


_EXT = _map_sql({e: lang for lang, es in T.LANGUAGES.items() for e in es.split()})
_LANG = rf"{_EXT}[lower(regexp_extract(file_path, '(\.[^./]+)$', 1))]"


@registry.query("detect_language", f"SELECT DISTINCT file_id, file_path, {_LANG} AS language FROM scanned_files")
def detect_language(spark, d):
    return table(spark, d, "scanned_files").select("file_id", "file_path", T.detect_language(c("file_path")).alias("language")).distinct()


@registry.query("files_by_language", f"SELECT coalesce({_LANG}, 'unknown') AS language, count(DISTINCT file_path) AS files, count(DISTINCT repo_name) AS repos FROM scanned_files GROUP BY 1")
def files_by_language(spark, d):
    files = table(spark, d, "scanned_files").withColumn("language", F.coalesce(T.detect_language(c("file_path")), F.lit("unknown")))
    return files.groupBy("language").agg(F.countDistinct("file_path").alias("files"), F.countDistinct("repo_name").alias("repos"))


@registry.query("chunk_id", "SELECT DISTINCT id, sha256(file_path || CAST(coalesce(start_line, 1) AS VARCHAR) || content) AS computed FROM chunks WHERE content IS NOT NULL")
def chunk_id(spark, d):
    computed = T.chunk_id(c("file_path"), F.coalesce("start_line", F.lit(1)), c("content")).alias("computed")
    return table(spark, d, "chunks").where("content is not null").select("id", computed).distinct()


_KIND = "CASE " + " ".join(rf"WHEN regexp_matches(t, '(^|\n){p}') THEN '{k}'" for k, p in T.KIND_PATTERNS) + " ELSE 'module' END"


@registry.query("infer_chunk_type", rf"SELECT DISTINCT id, {_KIND} AS kind FROM (SELECT id, regexp_replace(content, '^\s+', '') AS t FROM chunks WHERE content IS NOT NULL)")
def infer_chunk_type(spark, d):
    return table(spark, d, "chunks").where("content is not null").select("id", T.infer_kind(c("content")).alias("kind")).distinct()


_CODE_TOKENS = r"list_filter(string_split(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


@registry.query("code_tokenize", f"SELECT term, count(*) AS n FROM (SELECT unnest({_CODE_TOKENS.format('content')}) AS term FROM chunks WHERE content IS NOT NULL) GROUP BY 1")
def code_tokenize(spark, d):
    return table(spark, d, "chunks").where("content is not null").select(F.explode(T.code_tokens(c("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_WORDS = rf"list_filter(string_split_regex(regexp_replace(text, '[?.,!]', '', 'g'), '\s+'), lambda w: length(w) > 2 AND lower(w) NOT IN ({_lits(T.STOP_WORDS)}))"


@registry.query(
    "extract_keywords",
    rf"SELECT item_id, array_to_string(CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]'))) > 0 THEN list_filter(w, lambda x: regexp_matches(x, '[A-Z]')) ELSE w[1:3] END, '\|') AS keywords FROM (SELECT item_id, {_WORDS} AS w FROM eval_items)",
)
def extract_keywords(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.keywords(c("text")).alias("keywords"))


#: questions: the held-out items, and titles of work items turned into questions of every kind
_QUESTIONS = """q AS (SELECT 'e' || CAST(item_id AS VARCHAR) AS query_id, text FROM eval_items UNION ALL
 SELECT DISTINCT id || '-' || k, replace(replace(p, 'X', title), 'T', coalesce(type, 'class')) FROM backlog_items, (VALUES ('a', 'where is X defined'), ('b', 'who calls X in src/app/main.ts'), ('c', 'how does X work with python and T'), ('d', 'something similar to X test config')) v(k, p) WHERE title IS NOT NULL)"""


def _questions(spark, d):
    items = table(spark, d, "eval_items").select(F.concat(F.lit("e"), c("item_id").cast("string")).alias("query_id"), "text")
    forms = {"a": "where is X defined", "b": "who calls X in src/app/main.ts", "c": "how does X work with python and T", "d": "something similar to X test config"}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in forms.items())))
    titles = table(spark, d, "backlog_items").where("title is not null").select("id", "title", "type", each.alias("f"))
    asked = titles.select(F.concat_ws("-", "id", "f.k").alias("query_id"), F.replace(F.replace(c("f.p"), F.lit("X"), c("title")), F.lit("T"), F.coalesce("type", F.lit("class"))).alias("text")).distinct()
    return items.unionByName(asked)


_ASKED = "length(trim(text)) BETWEEN 1 AND 2000"
_INTENT = "CASE WHEN NOT (" + _ASKED + ") THEN 'general' " + " ".join(f"WHEN regexp_matches(text, '{'|'.join(f'(?:{p})' for p in ps)}', 'i') THEN '{k}'" for k, ps in T.INTENTS.items()) + " ELSE 'general' END"


@registry.query("query_intent", f"WITH {_QUESTIONS} SELECT query_id, {_INTENT} AS intent FROM q WHERE text IS NOT NULL")
def query_intent(spark, d):
    return _questions(spark, d).where("text is not null").select("query_id", T.intent(c("text")).alias("intent"))


_IDENT = T.IDENTIFIER.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")


@registry.query(
    "query_entities",
    rf"""WITH {_QUESTIONS}, p AS (SELECT query_id, list_distinct(regexp_extract_all(text, '{T.PATH}')) AS paths, list_distinct(list_filter(regexp_extract_all(text, '{_IDENT}', 1), lambda w: lower(w) NOT IN ({_lits(T.COMMON_WORDS)}))) AS names FROM q WHERE text IS NOT NULL AND {_ASKED})
    SELECT query_id, 'file' AS type, unnest(paths) AS value FROM p UNION ALL
    SELECT query_id, CASE WHEN regexp_matches(value, '^[A-Z]') THEN 'class' ELSE 'function' END, value FROM (SELECT query_id, unnest(list_filter(names, lambda n: NOT list_contains(paths, n))) AS value FROM p)""",
)
def query_entities(spark, d):
    return _questions(spark, d).where("text is not null").select("query_id", F.explode(T.entities(c("text"))).alias("e")).select("query_id", "e.type", "e.value")


def _named_sql(words: dict) -> str:
    return rf"list_sort(list_distinct(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: {_map_sql(words)}[w]), lambda x: x IS NOT NULL)))"


@registry.query("query_filters", f"WITH {_QUESTIONS} SELECT query_id, array_to_string({_named_sql(T.LANGUAGE_WORDS)}, ',') AS languages, array_to_string({_named_sql(T.KIND_WORDS)}, ',') AS kinds FROM q WHERE text IS NOT NULL")
def query_filters(spark, d):
    joined = lambda f: F.array_join(F.array_sort(f(c("text"))), ",")
    return _questions(spark, d).where("text is not null").select("query_id", joined(T.filter_languages).alias("languages"), joined(T.filter_kinds).alias("kinds"))


_EXP = "MAP {" + ", ".join(f"'{k}': [{_lits(v.split())}]" for k, v in T.EXPANSIONS.items()) + "}"


@registry.query(
    "query_expand",
    rf"""WITH {_QUESTIONS}, w AS (SELECT query_id, unnest(list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda w: w <> '')) AS word FROM q WHERE text IS NOT NULL)
    SELECT DISTINCT query_id, term FROM (SELECT query_id, word AS term FROM w UNION ALL SELECT query_id, unnest({_EXP}[word]) FROM w)""",
)
def query_expand(spark, d):
    return _questions(spark, d).where("text is not null").select("query_id", F.explode(T.expand_terms(c("text"))).alias("term"))


_REF_TEXT = "concat_ws(' ', 'see', external_id, description, 'and ' || external_id || ' CU-' || lower(replace(id, '-', '')) || ' #' || lower(replace(id, '-', '')) || 'xyz')"


def _ref_texts(spark, d):
    low = F.lower(F.replace(c("id"), F.lit("-"), F.lit("")))
    text = F.concat_ws(" ", F.lit("see"), "external_id", "description", F.concat(F.lit("and "), c("external_id"), F.lit(" CU-"), low, F.lit(" #"), low, F.lit("xyz")))
    return table(spark, d, "backlog_items").select("id", text.alias("t")).distinct()


def _scan(spark, d, kind):
    return _ref_texts(spark, d).select("id", F.posexplode(T.scan_references(c("t"), kind)).alias("pos", "ref"))


def _scan_sql(expr: str) -> str:
    return f"SELECT id, CAST(pos - 1 AS INT) AS pos, refs[pos] AS ref FROM (SELECT id, refs, unnest(range(1, len(refs) + 1)) AS pos FROM (SELECT id, {expr} AS refs FROM (SELECT DISTINCT id, {_REF_TEXT} AS t FROM backlog_items)))"


def _ordered_distinct(items: str) -> str:
    """DuckDB's list_distinct has no order, so first occurrences are kept by position."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


@registry.query("scan_ab", _scan_sql(_ordered_distinct(r"regexp_extract_all(t, 'AB#(\d+)', 1)")))
def scan_ab(spark, d):
    return _scan(spark, d, "ab")


@registry.query("scan_jira", _scan_sql(_ordered_distinct(r"regexp_extract_all(t, '\b([A-Z][A-Z0-9]+-\d+)\b', 1)")))
def scan_jira(spark, d):
    return _scan(spark, d, "jira")


@registry.query("scan_clickup", _scan_sql(_ordered_distinct(r"list_concat(regexp_extract_all(t, '\bCU-([a-z0-9]+)\b', 1), regexp_extract_all(t, '(?:^|\s)#([a-z0-9]{6,})\b', 1))")))
def scan_clickup(spark, d):
    return _scan(spark, d, "clickup")


_WIKI_TEXT = "coalesce(text, '') || ' [[' || doc_path || '|x]] [[ ' || source || ' ]] `[[code]]` #' || source || '/a #' || source || ' ```#no```'"


def _wiki_texts(spark, d):
    parts = F.concat(F.coalesce("text", F.lit("")), F.lit(" [["), c("doc_path"), F.lit("|x]] [[ "), c("source"), F.lit(" ]] `[[code]]` #"), c("source"), F.lit("/a #"), c("source"), F.lit(" ```#no```"))
    return table(spark, d, "documents").select("doc_id", parts.alias("t"))


@registry.query("extract_wikilinks", rf"SELECT DISTINCT doc_id, trim(string_split(l, '|')[1]) AS link FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\[\[([^\]]+)\]\]', 1)) AS l FROM (SELECT doc_id, {_WIKI_TEXT} AS t FROM documents)) WHERE trim(string_split(l, '|')[1]) <> ''")
def extract_wikilinks(spark, d):
    return _wiki_texts(spark, d).select("doc_id", F.explode(T.wikilinks(c("t"))).alias("link"))


@registry.query("extract_tags", rf"SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(t, '(?s)```.*?```', '', 'g'), '`[^`\n]*`', '', 'g'), '(?:^|\s)#([A-Za-z][\w/.-]*)', 1)) AS tag FROM (SELECT doc_id, {_WIKI_TEXT} AS t FROM documents))")
def extract_tags(spark, d):
    return _wiki_texts(spark, d).select("doc_id", F.explode(T.hashtags(c("t"))).alias("tag"))


def _of_kind(spark, d, *exts):
    return table(spark, d, "scanned_files").where(F.regexp_extract(F.lower("file_path"), r"\.([a-z]+)$", 1).isin(*exts) & c("content").isNotNull()).select("file_id", "content").distinct()


_CLEAN = r"list_filter(list_transform(string_split(replace(n, '{', ''), ','), lambda x: trim(string_split_regex(regexp_replace(x, '^\s+|\s+$', '', 'g'), '\s+as\s+')[1])), lambda x: x <> '')"


def _forms_sql(forms, exts: str) -> str:
    parts = []
    for kind, pattern, names, source, default, dynamic in forms:
        pattern = pattern.replace(r"(?!type\b)", "").replace("'", "''")
        drop = " WHERE n <> 'type'" if kind == "default" else ""
        n = f"regexp_extract_all(content, '{pattern}', {names})" if names else f"list_transform(regexp_extract_all(content, '{pattern}', {source}), lambda s: '')"
        parts.append(f"SELECT file_id, '{kind}' AS kind, s AS source, array_to_string({_CLEAN}, ',') AS names, {str(default).lower()} AS is_default, {str(dynamic).lower()} AS is_dynamic FROM (SELECT file_id, unnest(regexp_extract_all(content, '{pattern}', {source})) AS s, unnest({n}) AS n FROM f){drop}")
    return f"WITH f AS (SELECT DISTINCT file_id, content FROM scanned_files WHERE regexp_matches(lower(file_path), '\\.({exts})$') AND content IS NOT NULL) " + " UNION ALL ".join(parts)


def _imports(files, column):
    return files.select("file_id", F.explode(column).alias("i")).select("file_id", "i.kind", "i.source", F.array_join("i.names", ",").alias("names"), "i.is_default", "i.is_dynamic")


@registry.query("extract_imports_js", _forms_sql(T.JS_FORMS, "ts|js|tsx|jsx|mjs|cjs"))
def extract_imports_js(spark, d):
    return _imports(_of_kind(spark, d, "ts", "js", "tsx", "jsx", "mjs", "cjs"), T.js_imports(c("content")))


@registry.query("extract_imports_py", _forms_sql(T.PY_FORMS, "py|pyw"))
def extract_imports_py(spark, d):
    return _imports(_of_kind(spark, d, "py", "pyw"), T.py_imports(c("content")))


@registry.query(
    "extract_imports_go",
    r"""WITH f AS (SELECT DISTINCT file_id, 'import "fmt"' || chr(10) || 'import (' || chr(10) || ' l "x/y/log"' || chr(10) || ' "net/http"' || chr(10) || ')' || chr(10) || content AS content FROM scanned_files WHERE regexp_matches(lower(file_path), '\.go$') AND content IS NOT NULL),
    b AS (SELECT file_id, unnest(regexp_extract_all(content, '(?s)import\s*\((.*?)\)', 1)) AS b FROM f)
    SELECT file_id, 'single' AS kind, s AS source, regexp_extract(s, '([^/]*)$', 1) AS name FROM (SELECT file_id, unnest(regexp_extract_all(content, 'import\s+"([^"]+)"', 1)) AS s FROM f)
    UNION ALL SELECT file_id, 'block', s, CASE WHEN a <> '' THEN a ELSE regexp_extract(s, '([^/]*)$', 1) END FROM (SELECT file_id, unnest(regexp_extract_all(b, '(?:(\w+)\s+)?"([^"]+)"', 1)) AS a, unnest(regexp_extract_all(b, '(?:(\w+)\s+)?"([^"]+)"', 2)) AS s FROM b)""",
)
def extract_imports_go(spark, d):
    """Go files of the tables import nothing, so a header with both forms is put before each."""
    head = F.lit('import "fmt"\nimport (\n l "x/y/log"\n "net/http"\n)\n')
    files = _of_kind(spark, d, "go").select("file_id", F.concat(head, c("content")).alias("content"))
    return files.select("file_id", F.explode(T.go_imports(c("content"))).alias("i")).select("file_id", "i.kind", "i.source", "i.name")


_HTML = "'<h1>' || source || ' &amp; co</h1><ac:structured-macro ac:name=\"toc\">x</ac:structured-macro><p class=\"a\">' || coalesce(text, '') || '</p><br/>&copy; &#65;&#x42;&#0066;&#128512;&#x01F600;&#1114111;&quot;<li>' || repo_name || '</li>'"


def _entity_sql(expr: str) -> str:
    for k, v in T.ENTITIES.items():
        expr = "replace({}, '{}', '{}')".format(expr, k, v.replace("'", "''"))
    return expr


_HTML_SQL = rf"regexp_replace(regexp_replace(h, '<ac:structured-macro[^>]*ac:name=\"(toc|anchor|excerpt-include|include)\"[^>]*>.*?</ac:structured-macro>', '', 'gis'), '</?({'|'.join(T.BLOCK_TAGS)})[^>]*>', chr(10), 'gi')"
_HTML_SQL = _entity_sql(f"regexp_replace({_HTML_SQL}, '<[^>]+>', '', 'g')")
#: numeric references: pieces that begin with a decimal or a hexadecimal number, then the text behind
_NUMBER = "CASE WHEN x[1] <> chr(2) THEN CAST(split_part(x, chr(2), 1) AS INT) ELSE CAST(('0x' || split_part(split_part(x, chr(2), 2), chr(3), 1)) AS INT) END"
_PIECE = f"CASE WHEN contains(x, chr(3)) THEN chr(CASE WHEN {_NUMBER} BETWEEN 1 AND 1114111 AND {_NUMBER} NOT BETWEEN 55296 AND 57343 THEN {_NUMBER} ELSE 65533 END) || x[instr(x, chr(3)) + 1:] ELSE x END"
_HTML_SQL = rf"array_to_string(list_transform(string_split(regexp_replace({_HTML_SQL}, '&#(?:0*([0-9]{{1,7}})|[xX]0*([0-9a-fA-F]{{1,6}}));', chr(1) || '\1' || chr(2) || '\2' || chr(3), 'g'), chr(1)), lambda x: {_PIECE}), '')"
_HTML_SQL = rf"array_to_string(list_transform(string_split({_HTML_SQL}, chr(10)), lambda x: regexp_replace(x, '^[\s\x{{a0}}\x{{feff}}]+|[\s\x{{a0}}\x{{feff}}]+$', '', 'g')), chr(10))"
_HTML_SQL = rf"regexp_replace(regexp_replace({_HTML_SQL}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@registry.query("html_to_text", f"SELECT doc_id, sha256({_HTML_SQL}) AS digest FROM (SELECT doc_id, {_HTML} AS h FROM documents)")
def html_to_text(spark, d):
    h = F.concat(F.lit("<h1>"), c("source"), F.lit(' &amp; co</h1><ac:structured-macro ac:name="toc">x</ac:structured-macro><p class="a">'), F.coalesce("text", F.lit("")), F.lit("</p><br/>&copy; &#65;&#x42;&#0066;&#128512;&#x01F600;&#1114111;&quot;<li>"), c("repo_name"), F.lit("</li>"))
    return table(spark, d, "documents").select("doc_id", F.sha2(T.html_to_text(h), 256).alias("digest"))


@registry.query(
    "edit_similarity",
    "SELECT DISTINCT id, CASE WHEN greatest(length(nl_summary), length(metadata.name)) = 0 THEN 1.0 ELSE round(1 - levenshtein(nl_summary, metadata.name) / greatest(length(nl_summary), length(metadata.name)), 6) END AS similarity FROM chunks WHERE nl_summary IS NOT NULL AND metadata.name IS NOT NULL",
)
def edit_similarity(spark, d):
    chunks = table(spark, d, "chunks").where("nl_summary is not null and metadata.name is not null")
    return chunks.select("id", F.round(T.edit_similarity(c("nl_summary"), c("metadata.name")), 6).alias("similarity")).distinct()


@registry.query("exact_match", r"SELECT DISTINCT id, trim(regexp_replace(content, '\s+', ' ', 'g')) = trim(regexp_replace(rtrim(content, ' }'), '\s+', ' ', 'g')) AS same FROM chunks WHERE content IS NOT NULL")
def exact_match(spark, d):
    return table(spark, d, "chunks").where("content is not null").select("id", T.exact_match(c("content"), F.rtrim(c("content"), F.lit(" }"))).alias("same")).distinct()


@registry.query(
    "truncate_context",
    "SELECT doc_id, sha256(CASE WHEN length(text) <= 500 THEN text WHEN b > 0 AND length(h) - b > 250 THEN h[1:length(h) - b] ELSE h END) AS digest FROM (SELECT doc_id, text, text[1:500] AS h, instr(array_to_string(list_reverse(string_split(text[1:500], '')), ''), chr(10)) AS b FROM documents WHERE text IS NOT NULL)",
)
def truncate_context(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.truncate_context(c("text")), 256).alias("digest"))


@registry.query("valid_id", r"SELECT DISTINCT x AS id, regexp_full_match(x, '[A-Za-z0-9_\-:.]+') AND length(x) BETWEEN 1 AND 256 AS valid FROM (SELECT id AS x FROM chunks UNION ALL SELECT id FROM graph_nodes) WHERE x IS NOT NULL")
def valid_id(spark, d):
    ids = table(spark, d, "chunks").select("id").unionByName(table(spark, d, "graph_nodes").select("id")).where("id is not null").distinct()
    return ids.select("id", T.valid_id(c("id")).alias("valid"))


@registry.query(
    "safe_cast",
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS number,
    CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events""",
)
def safe_cast(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", T.safe_cast(k, "int", -1).alias("k"), T.safe_cast(c("event_type"), "double", 0.0).alias("number"), T.one_of(c("event_type"), ["click", "view"], "other").alias("kind"))


@registry.query(
    "format_compact",
    "SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1f', round(n / 1e6, 1)) || 'M' WHEN n >= 1000 THEN printf('%.1f', round(n / 1e3, 1)) || 'K' ELSE CAST(n AS VARCHAR) END AS compact FROM (SELECT o_orderkey, CAST(floor(o_totalprice * (CASE WHEN o_orderkey % 3 = 0 THEN 100 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0.001 END)) AS BIGINT) AS n FROM orders)",
)
def format_compact(spark, d):
    k = c("o_orderkey") % 3
    n = F.floor(c("o_totalprice") * F.when(k == 0, 100).when(k == 1, 1).otherwise(0.001)).cast("bigint")
    return table(spark, d, "orders").select("o_orderkey", T.format_compact(n).alias("compact"))


@registry.query(
    "relative_time",
    """SELECT doc_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' WHEN s < 2592000 THEN CAST(s // 86400 AS VARCHAR) || 'd ago' ELSE strftime(created_at, '%Y-%m-%d') END AS age
    FROM (SELECT doc_id, created_at, epoch_ms(date_trunc('second', ingested_at)) // 1000 - epoch_ms(date_trunc('second', created_at)) // 1000 AS s FROM documents WHERE created_at IS NOT NULL AND ingested_at IS NOT NULL)""",
)
def relative_time(spark, d):
    at = lambda x: c(x).cast("timestamp")
    return table(spark, d, "documents").where("created_at is not null and ingested_at is not null").select("doc_id", T.relative_time(at("created_at"), at("ingested_at")).alias("age"))


@registry.query("infer_source", r"SELECT file_path, CASE WHEN contains(file_path, 'confluence') THEN 'confluence' WHEN regexp_matches(lower(file_path), '\.mdx?$') THEN 'markdown' ELSE 'unknown' END AS source, count(*) AS n FROM chunks WHERE file_path IS NOT NULL GROUP BY 1, 2")
def infer_source(spark, d):
    return table(spark, d, "chunks").where("file_path is not null").groupBy("file_path", T.infer_source(c("file_path")).alias("source")).agg(F.count("*").alias("n"))


@registry.query(
    "docstring_quality",
    r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS tokens FROM documents WHERE source = 'docstring' AND regexp_replace(text, '\s+', '', 'g') <> '' AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) >= 3",
)
def docstring_quality(spark, d):
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    rows = table(spark, d, "documents").where((c("source") == "docstring") & (F.regexp_replace("text", r"\s+", "") != ""))
    return rows.select("doc_id", tokens.alias("tokens")).where("tokens >= 3")


@registry.query(
    "fnv1a_id",
    "SELECT DISTINCT id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ord(id[i])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS point FROM chunks WHERE id IS NOT NULL",
)
def fnv1a_id(spark, d):
    return table(spark, d, "chunks").where("id is not null").select("id").distinct().select("id", T.fnv1a(c("id")).alias("point"))
