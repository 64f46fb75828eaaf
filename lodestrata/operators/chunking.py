"""Chunks of code and Markdown.

Lines, declarations and sections are arrays of the row they come from, so a
file is never spread over rows and put together again: no shuffle, and codegen
throughout. Only the oversize splitter, whose every cut depends on the cut
before, is a loop in Python.

Declarations are found by patterns at column 0 (Python files may use ``ast`` as
well); grammars are not available here, so this is an approximation.

Defined edge cases: null and blank contents have no chunks; a file without
declarations is one ``module``; an unterminated fence is no block; text before the
first heading is a section of level 0 if it is not blank.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.vector import let

c = F.col

# patterns of top-level declarations by language; the last group is the name
DECLARATIONS = {
    "javascript": r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|interface|type|enum|function|const|let|var)\s+([A-Za-z_$][\w$]*)",
    "python": r"^(?:async\s+)?(?:def|class)\s+(\w+)",
    "go": r"^(?:func|type|var|const)\s+(?:\([^)]*\)\s*)?(\w+)",
    "java": r"^(?:public\s+|private\s+|protected\s+|final\s+|abstract\s+|static\s+)*(?:class|interface|enum|record)\s+(\w+)",
    "rust": r"^(?:pub(?:\([\w:\s]+\))?\s+)?(?:default\s+|unsafe\s+|async\s+|const\s+(?=fn\b|unsafe\b|async\b|extern\b)|extern\s+(?:\"[^\"]*\"\s+)?(?=fn\b))*(?:(?:fn|struct|enum|union|trait|type|mod|macro_rules!)\s+|(?:const|static)\s+(?:mut\s+)?|impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>,'&\s]+?\s+for\s+)?)(\w+)",
    "c_sharp": r"^\s{0,4}(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|unsafe|file|new)\s+)*(?:class|interface|enum|struct|record(?:\s+(?:class|struct))?|namespace|delegate\s+[\w<>\[\],.?]+)\s+([\w.]+)",
    "c": r"^(?!(?:return|else|goto|case|extern\s+\"C\"|typedef)\b)(?:(?:struct|enum|union)\s+(?=\w+\s*\{)|(?:[A-Za-z_]\w*[\s*]+)+(?=\w+\s*(?:\(|=|;|\[)))(\w+)",
    "cpp": r"^(?!(?:return|else|goto|case|using|typedef|extern\s+\"C\")\b)(?:template\s*<[^{;]*>\s*)?(?:(?:class|struct|enum(?:\s+class)?|union|namespace|concept)\s+(?=\w+(?:\s*\{|\s*:|\s+final\b|\s*=|\s*$))|(?:[A-Za-z_][\w:]*(?:<[^;{]*>)?[\s*&]+)+(?=[\w:~]+\s*(?:\(|=|;|\[|\{))|(?=\w+(?:::~?\w+)+\s*\())([\w:~]+)",
    "ruby": r"^(?:class|module|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)",
    "php": r"^(?:(?:abstract|final|readonly)\s+)*(?:class|interface|trait|enum|function)\s+&?(\w+)",
}
SAME = {"typescript": "javascript", "tsx": "javascript"}


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def declared_name(line: Column, language: Column) -> Column:
    """Name that a line declares, or the empty string."""
    out = F.lit("")
    for lang, pattern in DECLARATIONS.items():
        names = [lang, *(k for k, v in SAME.items() if v == lang)]
        out = F.when(language.isin(names), F.regexp_extract(line, pattern, 1)).otherwise(out)
    return out


def declarations(content: Column, language: Column) -> Column:
    """``ARRAY<STRUCT<line, name>>`` of the declarations, lines from 1."""
    named = F.transform(lines_of(content), lambda x, i: F.struct((i + 1).alias("line"), declared_name(x, language).alias("name")))
    return F.filter(named, lambda x: x["name"] != "")


def regions(content: Column, language: Column) -> Column:
    """``ARRAY<STRUCT<name, start_line, end_line>>``: from each declaration to the next or the end."""
    total = F.size(lines_of(content))
    return let(declarations(content, language), lambda d: F.transform(d, lambda x, i: F.struct(x["name"].alias("name"), x["line"].alias("start_line"), F.coalesce(F.get(d, i + 1)["line"] - 1, total).alias("end_line"))))


def cut_lines(content: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines_of(content), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def chunk_code(files: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """``file_path, name, chunk_type, start_line, end_line, content, id``: one chunk per declaration, and what stands before the first."""
    known = files.select(c(path).alias("file_path"), c(content).alias("content"), T.detect_language(c(path)).alias("language")).where((F.regexp_replace("content", r"\s+", "") != "") & c("language").isNotNull()).distinct()
    found = known.withColumn("regions", regions(c("content"), c("language"))).withColumn("total", F.size(lines_of(c("content"))))
    empty = F.size("regions") == 0
    head = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.when(empty, c("total")).otherwise(c("regions")[0]["start_line"] - 1).alias("end_line")))
    first = F.when(empty, F.lit(1)).otherwise(c("regions")[0]["start_line"])
    parts = F.when(empty, head).when(first > 1, F.concat(head, c("regions"))).otherwise(c("regions"))
    rows = found.select("file_path", "content", empty.alias("whole"), F.explode(parts).alias("r"))
    body = F.regexp_replace(cut_lines(c("content"), c("r.start_line"), c("r.end_line")), r"\n+\z", "")
    cut = rows.select("file_path", "whole", "r.name", "r.start_line", "r.end_line", body.alias("content")).where(F.regexp_replace("content", r"\s+", "") != "")
    kind = F.when(c("whole"), "module").when(c("name").isNull(), "import_block").otherwise(T.infer_kind(c("content")))
    return cut.select("file_path", "name", kind.alias("chunk_type"), "start_line", "end_line", "content", T.chunk_id(c("file_path"), c("start_line"), c("content")).alias("id"))


def python_declarations(files: DataFrame) -> DataFrame:
    """``file_path, name, line, kind`` of the top level of Python files by their syntax tree; files that do not parse have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.file_path, pdf.content):
                try:
                    tree = ast.parse(content.lstrip("﻿"))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(path, n.name, n.lineno, "class" if isinstance(n, ast.ClassDef) else "function") for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
            if rows:
                yield pd.DataFrame(rows, columns=["file_path", "name", "line", "kind"])

    return files.where("content is not null").select("file_path", "content").distinct().mapInPandas(run, "file_path string, name string, line int, kind string")


# ---- Markdown -----------------------------------------------------------------------------

# fixed value: the form of a heading
HEADING = r"^(#{1,6})\s+(.+?)\s*$"


def sections(text: Column) -> Column:
    """``ARRAY<STRUCT<heading, level, start_line, end_line>>``; heading lines open sections, also inside fences."""
    rows = lines_of(F.replace(text, F.lit("\r"), F.lit("")))
    heads = F.filter(F.transform(rows, lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, HEADING, 2).alias("heading"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"))), lambda x: x["level"] > 0)
    start = F.array(F.struct(F.lit(1).alias("line"), F.lit("").alias("heading"), F.lit(0).alias("level")))
    with_start = let(heads, lambda h: F.when(F.coalesce(F.get(h, F.lit(0))["line"], F.lit(0)) == 1, h).otherwise(F.concat(start, h)))
    return let(with_start, lambda h: F.transform(h, lambda x, i: F.struct(x["heading"].alias("heading"), x["level"].alias("level"), x["line"].alias("start_line"), F.coalesce(F.get(h, i + 1)["line"] - 1, F.size(rows)).alias("end_line"))))


def code_blocks(text: Column) -> Column:
    """``ARRAY<STRUCT<language, start_line, end_line, code>>`` of closed fences."""
    rows = lines_of(F.replace(text, F.lit("\r"), F.lit("")))
    fences = F.filter(F.transform(rows, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda x: x["text"].rlike(r"^\s*```"))

    def pairs(f: Column) -> Column:
        opened = F.filter(F.transform(f, lambda x, i: F.struct(x["line"].alias("a"), F.get(f, i + 1)["line"].alias("b"), x["text"].alias("t"), i.alias("i"))), lambda x: (x["i"] % 2 == 0) & x["b"].isNotNull())
        return F.transform(opened, lambda x: F.struct(F.regexp_extract(x["t"], r"```\s*(\w*)", 1).alias("language"), x["a"].alias("start_line"), x["b"].alias("end_line"), F.array_join(F.slice(rows, x["a"] + 1, F.greatest(F.lit(0), x["b"] - x["a"] - 1)), "\n").alias("code")))

    return let(fences, pairs)


def frontmatter(text: Column) -> Column:
    """``STRUCT<title, tags, aliases, body_line>`` of a leading ``---`` block: scalars, inline and block lists; no block: nulls and line 1."""
    block = F.regexp_extract(F.replace(text, F.lit("\r"), F.lit("")), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    scalar = lambda key: F.nullif(clean(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\n\[]+)$", 1)), F.lit(""))

    def items(key: str) -> Column:
        inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]\n]*)\]", 1)
        listed = F.regexp_extract_all(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]*[^\n]*\n?)+)", 1), F.lit(r"-[ \t]*([^\n]*)"), F.lit(1))
        return F.filter(F.transform(F.when(inline != "", F.split(inline, ",")).otherwise(listed), clean), lambda x: x != "")

    line = F.when(block == "", 1).otherwise(F.size(F.split(block, "\n", -1)) + 3)
    return F.struct(scalar("title").alias("title"), items("tags").alias("tags"), items("aliases").alias("aliases"), line.alias("body_line"))


def chunk_markdown(docs: DataFrame, path: str = "file_path", content: str = "content", max_tokens: int = 1024) -> DataFrame:
    """``file_path, name, level, start_line, end_line, content, links, tags, id``: sections, cut at blank lines where they exceed ``max_tokens``."""
    rows = docs.select(c(path).alias("file_path"), F.replace(c(content), F.lit("\r"), F.lit("")).alias("content")).where(F.regexp_replace("content", r"\s+", "") != "")
    cut = rows.withColumn("fm", frontmatter(c("content"))).select("file_path", "content", "fm", F.explode(sections(c("content"))).alias("s"))
    body = cut.select("file_path", "fm", "s.heading", "s.level", F.greatest(c("s.start_line"), c("fm.body_line")).alias("start_line"), "s.end_line", "content").where("start_line <= end_line")
    texts = body.withColumn("content", cut_lines(c("content"), c("start_line"), c("end_line"))).where(F.regexp_replace("content", r"\s+", "") != "")
    sized = texts.withColumn("name", F.coalesce(F.nullif("heading", F.lit("")), "fm.title", F.lit("(document)")))
    split = split_oversize(sized.select("file_path", "name", "level", "start_line", "content", c("fm.tags").alias("head_tags")), max_tokens, keep=["file_path", "name", "level", "head_tags"])
    return split.select("file_path", "name", "level", "start_line", "end_line", "content", T.wikilinks(c("content")).alias("links"), F.array_union("head_tags", T.hashtags(c("content"))).alias("tags"), T.chunk_id(c("file_path"), c("start_line"), c("content")).alias("id"))


def cut_oversize(content: str, max_tokens: int) -> list[tuple[int, str]]:
    """``(first line from 0, text)`` of the parts: a part closes once it reaches ``max_tokens``, at its last blank or closing line after the first, or whole."""
    parts: list[tuple[int, str]] = []
    held: list[str] = []
    first = size = 0
    for number, line in enumerate(content.split("\n")):
        held.append(line)
        size += len(line) + (len(held) > 1)
        if -(-size // 4) < max_tokens:
            continue
        at = next((i for i in range(len(held) - 2, 0, -1) if held[i].strip() in ("", "}", "};")), len(held) - 1)
        parts.append((first, "\n".join(held[: at + 1])))
        held, first = held[at + 1 :], first + at + 1
        size = len("\n".join(held))
    parts.append((first, "\n".join(held)))
    return [(n, p) for n, p in parts if p.strip()]


def split_oversize(rows: DataFrame, max_tokens: int, keep: list[str], content: str = "content", line: str = "start_line") -> DataFrame:
    """``keep`` columns, ``start_line, end_line, content`` of the parts of every row; rows that fit are one part."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                text = row[content]
                parts = [(0, text)] if -(-len(text) // 4) <= max_tokens else cut_oversize(text, max_tokens)
                out += [(*(row[k] for k in keep), row[line] + n, row[line] + n + p.count("\n"), p) for n, p in parts]
            if out:
                yield pd.DataFrame(out, columns=[*keep, "start_line", "end_line", "content"])

    return rows.select(*keep, line, content).mapInPandas(run, f"{schema}, start_line int, end_line int, content string")
