"""Text functions as Columns: tokens, extractors, entities, similarity, formats.

Null in, null out, unless a docstring says otherwise. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file extensions by language
LANGUAGES = {
    "javascript": ".js .jsx .mjs .cjs",
    "typescript": ".ts .mts .cts",
    "tsx": ".tsx",
    "python": ".py .pyw",
    "go": ".go",
    "rust": ".rs",
    "java": ".java",
    "c_sharp": ".cs",
    "c": ".c .h",
    "cpp": ".cpp .cc .cxx .hpp .hxx",
    "ruby": ".rb",
    "php": ".php",
}

# fixed values: words without weight in keyword queries
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall must "
    "in on at to for of with by from as into through during before after above below and but or nor not so yet "
    "it its this that these those i me my we our you your he she they what which who whom when where why how "
    "find show get list display defined work works working used using use happen happens between each other"
).split()

# fixed values: common words that are no entities
COMMON_WORDS = (
    "is the in of to and or for by it be do an as at if on no not but with that this from are was has had have how what when where who "
    "which all can will one its into been like does used find show get set"
).split()

# fixed values: what a query asks for, in order of precedence
INTENTS = {
    "find_definition": [r"where\s+is\s+\S+\s+defined", r"definition\s+of", r"find\s+definition", r"define[ds]?\s", r"declaration\s+of", r"where\s+is\s+\S+\s+declared", r"show\s+(me\s+)?(the\s+)?definition"],
    "find_usage": [r"who\s+calls", r"usage\s+of", r"used\s+by", r"references?\s+to", r"callers?\s+of", r"where\s+is\s+\S+\s+used", r"find\s+usage", r"consumers?\s+of"],
    "understand_module": [r"how\s+does\s+\S+\s+work", r"explain\s", r"what\s+does\s+\S+\s+do", r"understand\s", r"overview\s+of", r"describe\s", r"how\s+is\s+\S+\s+implemented"],
    "find_similar": [r"similar\s+to", r"like\s+\S+", r"resembl", r"alternatives?\s+(to|for)", r"related\s+to"],
}

# fixed values: terms that stand for each other
EXPANSIONS = {
    "test": "test spec describe it expect assert",
    "error": "error exception throw catch fail",
    "config": "config configuration settings options preferences",
    "auth": "auth authentication authorization login session token",
    "api": "api endpoint route handler controller",
    "database": "database db query schema migration model",
    "log": "log logger logging debug trace",
    "import": "import require dependency module",
    "export": "export module public",
    "type": "type interface typedef schema",
    "async": "async await promise callback",
    "render": "render component template view",
}

# fixed values: query words that name a language or a kind of chunk
LANGUAGE_WORDS = {"typescript": "typescript", "ts": "typescript", "javascript": "javascript", "js": "javascript", "python": "python", "py": "python", "rust": "rust", "go": "go", "java": "java", "c#": "csharp", "csharp": "csharp"}
KIND_WORDS = {"function": "function", "functions": "function", "method": "method", "methods": "method", "class": "class", "classes": "class", "interface": "interface", "interfaces": "interface", "type": "type_alias", "types": "type_alias", "module": "module", "modules": "module"}

# fixed values: kinds of chunk by the first pattern that a line of them matches
KIND_PATTERNS = [
    ("class", r"(export\s+)?(abstract\s+)?class\s+"),
    ("interface", r"(export\s+)?interface\s+"),
    ("type_alias", r"(export\s+)?type\s+\w+"),
    ("function", r"(export\s+)?(async\s+)?function\s+"),
    ("function", r"(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?\("),
    ("function", r"(export\s+)?(const|let|var)\s+\w+\s*=\s*(async\s+)?function"),
    ("module", r"(export\s+)?(const|let|var)\s+"),
    ("import_block", r"import\s+"),
    ("function", r"(def|async\s+def)\s+"),
    ("class", r"class\s+"),
    ("function", r"(func|fn|pub\s+fn)\s+"),
    ("class", r"(struct|impl|trait|enum)\s+"),
]

# fixed values: named entities of HTML in the order of decoding
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™",
}
BLOCK_TAGS = "p div h1 h2 h3 h4 h5 h6 li tr br hr blockquote pre table thead tbody tfoot".split()

PATH = r"[\w./-]+/[\w.-]+\.\w+"
# word boundaries are those of ASCII words, which Java's \b is not
IDENTIFIER = r"(?<![A-Za-z0-9_])([A-Z][a-zA-Z0-9]*(?:[A-Z][a-z0-9]*)*|[a-z][a-zA-Z0-9]*(?:[A-Z][a-z0-9]*)+)(?![A-Za-z0-9_])"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, with repetition; null text: no terms."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Tokens of a text at four characters each, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def detect_language(path: Column) -> Column:
    """Language by file extension; null where unknown."""
    by = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}
    return F.try_element_at(_map(by), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def chunk_id(path: Column, line: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, line.cast("string"), content), 256)


def embed_text(summary: Column, content: Column) -> Column:
    """The text to embed: summary and content, or content alone where the summary is null or empty."""
    return F.when(F.length(summary) > 0, F.concat(summary, F.lit("\n\n"), content)).otherwise(content)


def infer_kind(content: Column) -> Column:
    """Kind of a chunk by the first pattern, in order, that any of its lines starts with."""
    trimmed = F.regexp_replace(content, r"^\s+", "")
    out = F.lit("module")
    for kind, pattern in reversed(KIND_PATTERNS):
        out = F.when(trimmed.rlike(r"(^|\n)" + pattern), kind).otherwise(out)
    return F.when(content.isNotNull(), out)


def code_tokens(text: Column) -> Column:
    """Lower-case words of code: camel case split, everything else than letters and digits separates."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^a-zA-Z0-9]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda w: w != "")


def keywords(query: Column) -> Column:
    """Search words of a question: those with capitals, or else the first three, joined by ``\\|``."""
    words = F.filter(F.split(F.regexp_replace(query, r"[?.,!]", ""), r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOP_WORDS))
    named = F.filter(words, lambda w: w.rlike("[A-Z]"))
    return F.array_join(F.when(F.size(named) > 0, named).otherwise(F.slice(words, 1, 3)), "\\|")


def _asked(query: Column) -> Column:
    trimmed = F.trim(query)
    return (F.length(trimmed) > 0) & (F.length(trimmed) <= 2000)


def intent(query: Column) -> Column:
    """First intent one of whose patterns occurs; ``general`` for blank, overlong and other queries."""
    out = F.lit("general")
    for name, patterns in reversed(INTENTS.items()):
        out = F.when(query.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), name).otherwise(out)
    return F.when(_asked(query), out).otherwise("general")


def entities(query: Column) -> Column:
    """``ARRAY<STRUCT<type, value>>``: paths, then names (capitalised: class, else function), each once."""
    found = F.array_distinct(_all(query, PATH))
    names = F.array_distinct(F.filter(_all(query, IDENTIFIER, 1), lambda w: ~F.lower(w).isin(COMMON_WORDS)))
    paths = F.transform(found, lambda v: F.struct(F.lit("file").alias("type"), v.alias("value")))
    others = F.transform(F.array_except(names, found), lambda v: F.struct(F.when(v.rlike("^[A-Z]"), "class").otherwise("function").alias("type"), v.alias("value")))
    return F.when(_asked(query), F.concat(paths, others)).otherwise(F.slice(F.concat(paths, others), 1, 0))


def _named_words(query: Column, words: dict) -> Column:
    found = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.try_element_at(_map(words), w))
    return F.array_distinct(F.filter(found, lambda w: w.isNotNull()))


def filter_languages(query: Column) -> Column:
    return _named_words(query, LANGUAGE_WORDS)


def filter_kinds(query: Column) -> Column:
    return _named_words(query, KIND_WORDS)


def expand_terms(query: Column) -> Column:
    """The query's words, then the terms that stand for them, each once."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    table = F.create_map(*(x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*(F.lit(t) for t in v.split())))))
    more = F.flatten(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda a: a.isNotNull()))
    return F.array_distinct(F.concat(words, more))


def scan_references(text: Column, kind: str, project: str | None = None) -> Column:
    """Work items named in a text, each once in order: ``ab`` (``AB#1`` -> 1), ``jira`` (``ABC-1``), ``clickup`` (``CU-x``, ``#x``)."""
    if kind == "ab":
        return F.array_distinct(_all(text, r"AB#(\d+)", 1))
    if kind == "jira":
        return F.array_distinct(_all(text, rf"\b({project or '[A-Z][A-Z0-9]+'}-\d+)\b", 1))
    return F.array_distinct(F.concat(_all(text, r"\bCU-([a-z0-9]+)\b", 1), _all(text, r"(?:^|\s)#([a-z0-9]{6,})\b", 1)))


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target|label]]``, trimmed, each once in order."""
    inner = F.transform(_all(text, r"\[\[([^\]]+)\]\]", 1), lambda x: F.trim(F.split(x, r"\|")[0]))
    return F.array_distinct(F.filter(inner, lambda x: x != ""))


def without_code(text: Column) -> Column:
    """The text without fenced and inline code."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")


def hashtags(text: Column) -> Column:
    """``#tags`` outside code, each once in order."""
    return F.array_distinct(_all(without_code(text), r"(?:^|\s)#([A-Za-z][\w/.-]*)", 1))


def html_to_text(html: Column) -> Column:
    """Visible text of HTML or XHTML storage: blocks on lines of their own, entities decoded, blank lines collapsed."""
    t = F.regexp_replace(html, r'(?is)<ac:structured-macro[^>]*ac:name="(toc|anchor|excerpt-include|include)"[^>]*>.*?</ac:structured-macro>', "")
    t = F.regexp_replace(t, r"(?is)<ac:plain-text-body>\s*<!\[CDATA\[(.*?)\]\]>\s*</ac:plain-text-body>", "$1\n")
    t = F.regexp_replace(t, r"(?is)<ac:rich-text-body>(.*?)</ac:rich-text-body>", "$1\n")
    t = F.regexp_replace(t, r"(?i)</?(ac|ri|at):[^>]*>", "")
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(BLOCK_TAGS)})[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    # numeric references: text and number alternate, so each piece is decoded in place
    pieces = F.split(F.regexp_replace(t, r"&#(?:0*(\d{1,7})|[xX]0*([0-9a-fA-F]{1,6}));", "\u0001$1\u0002$2\u0003"), "\u0001")
    def code(p: Column) -> Column:
        dec, hexa = F.regexp_extract(p, "^(\\d*)\u0002", 1), F.regexp_extract(p, "\u0002([0-9a-fA-F]*)\u0003", 1)
        number = F.when(dec != "", dec.cast("int")).otherwise(F.conv(hexa, 16, 10).cast("int"))
        # what is no character, as HTML has it, is the replacement character
        number = F.when((number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF), number).otherwise(0xFFFD)
        return F.when(p.contains("\u0003"), F.concat(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"), F.regexp_extract(p, "(?s)\u0003(.*)$", 1))).otherwise(p)
    t = F.array_join(F.transform(pieces, code), "")
    lines = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def exact_match(a: Column, b: Column) -> Column:
    """Equality up to white space."""
    return _squeeze(a) == _squeeze(b)


def truncate_context(text: Column, limit: int = 500) -> Column:
    """At most ``limit`` characters, cut at the last line feed if that lies past the half."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(head), "\n")
    at = F.when(back > 0, F.length(head) - back).otherwise(F.lit(-1))
    return F.when(F.length(text) <= limit, text).when(at > limit * 0.5, F.substr(head, F.lit(1), at)).otherwise(head)


def parse_score(reply: Column) -> Column:
    """First integer of a model's reply, 0 to 100; 50 where there is none."""
    digits = F.regexp_extract(reply, r"(\d{1,9})", 1)
    return F.when(F.coalesce(digits, F.lit("")) == "", 50).otherwise(F.least(F.lit(100), F.when(digits != "", digits).cast("int"))).cast("int")


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a hash of the UTF-8 bytes, as a bigint; ids made of it may collide."""
    size = F.octet_length(value)
    digits = F.hex(F.encode(value, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.lit(2166136261).cast("bigint")
    return F.when(size == 0, start).otherwise(F.aggregate(octets, start, lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296))


def valid_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9_\-:.]+\z") & F.length(value).between(1, 256), F.lit(False))


def safe_cast(value: Column, kind: str, default) -> Column:
    """The value as ``kind``, or the default where it is null or no such value."""
    return F.coalesce(value.try_cast(kind), F.lit(default).cast(kind))


def one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def format_compact(n: Column) -> Column:
    """1234 -> 1.2K, 2500000 -> 2.5M."""
    short = lambda x: F.format_string("%.1f", F.round(x, 1))
    return F.when(n >= 1_000_000, F.concat(short(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(short(n / 1e3), F.lit("K"))).otherwise(n.cast("string"))


def relative_time(then: Column, now: Column) -> Column:
    """Age in words: just now, minutes, hours, days; the date after 30 days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    part = lambda size, unit: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s < 30 * 86400, part(86400, "d")).otherwise(F.date_format(then, "yyyy-MM-dd"))


def infer_source(path: Column) -> Column:
    """Where a document comes from, by its path."""
    return F.when(path.contains("confluence"), "confluence").when(F.lower(path).rlike(r"\.mdx?$"), "markdown").otherwise("unknown")


# ---- imports ------------------------------------------------------------------------------

_NAME, _FROM = r"[A-Za-z_$][\w$]*", r"\s+from\s+['\"]([^'\"]+)['\"]"
# fixed values: forms of import statements as (kind, pattern, group of names, group of source, default, dynamic)
JS_FORMS = [
    ("named", r"import\s+(?:type\s+)?\{([^}]+)\}" + _FROM, 1, 2, False, False),
    ("default", rf"import\s+(?!type\b)({_NAME})" + _FROM, 1, 2, True, False),
    ("default_named", rf"import\s+({_NAME}\s*,\s*\{{[^}}]+)\}}" + _FROM, 1, 2, True, False),
    ("namespace", rf"import\s+\*\s+as\s+({_NAME})" + _FROM, 1, 2, False, False),
    ("side_effect", r"import\s+['\"]([^'\"]+)['\"]", 0, 1, False, False),
    ("dynamic", r"import\(\s*['\"]([^'\"]+)['\"]\s*\)", 0, 1, False, True),
    ("require", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", 0, 1, False, False),
    ("reexport", r"export\s+\{([^}]+)\}" + _FROM, 1, 2, False, False),
    ("reexport_all", r"export\s+\*" + _FROM, 0, 1, False, False),
]
PY_FORMS = [("from", r"from\s+([\w.]+)\s+import\s+([^(\n]+)", 2, 1, False, False), ("import", r"(?m)^import\s+([\w.]+)(?:\s+as\s+\w+)?", 1, 1, True, False)]


def _forms(text: Column, forms: list[tuple]) -> Column:
    """``ARRAY<STRUCT<kind, source, names, is_default, is_dynamic>>`` in the order of the forms."""
    clean = lambda r: F.filter(F.transform(F.split(F.replace(r, F.lit("{"), F.lit("")), ","), lambda x: F.trim(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+as\s+")[0])), lambda x: x != "")

    def part(kind: str, pattern: str, names_at: int, source_at: int, default: bool, dynamic: bool) -> Column:
        sources = _all(text, pattern, source_at)
        raw = _all(text, pattern, names_at) if names_at else F.transform(sources, lambda _: F.lit(""))
        return F.zip_with(sources, raw, lambda s, r: F.struct(F.lit(kind).alias("kind"), s.alias("source"), clean(r).alias("names"), F.lit(default).alias("is_default"), F.lit(dynamic).alias("is_dynamic")))

    parts = [part(*form) for form in forms]
    return F.concat(*parts)


def js_imports(text: Column) -> Column:
    return _forms(text, JS_FORMS)


def py_imports(text: Column) -> Column:
    return _forms(text, PY_FORMS)


def go_imports(text: Column) -> Column:
    """``ARRAY<STRUCT<kind, source, name>>``: single imports, then blocks; the name is the alias or the last part of the path."""
    last = lambda s: F.regexp_extract(s, r"([^/]*)$", 1)
    single = F.transform(_all(text, r"import\s+\"([^\"]+)\"", 1), lambda s: F.struct(F.lit("single").alias("kind"), s.alias("source"), last(s).alias("name")))
    blocks = _all(text, r"(?s)import\s*\((.*?)\)", 1)
    inner = F.flatten(F.transform(blocks, lambda b: F.arrays_zip(_all(b, r"(?:(\w+)\s+)?\"([^\"]+)\"", 1).alias("a"), _all(b, r"(?:(\w+)\s+)?\"([^\"]+)\"", 2).alias("s"))))
    block = F.transform(inner, lambda x: F.struct(F.lit("block").alias("kind"), x["s"].alias("source"), F.when(x["a"] != "", x["a"]).otherwise(last(x["s"])).alias("name")))
    return F.concat(single, block)
