"""Files: directory scans, ignore rules, version-control output, JSON lines, reports, text of office and PDF files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: fixed values: folders that scans leave out
IGNORED = ("node_modules/", ".git/", "dist/", "build/", "coverage/")


#: names of files whose lines are ignore patterns for the folder that they stand in
IGNORE_FILES = (".gitignore", ".indexignore")


def _system(path: str):
    """The file system of a path (a URI or a local path) and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _below(path: str, recursive: bool) -> Iterator[tuple[str, int | None]]:
    """Places below ``path``, relative to it, with lengths; folders have none."""
    from pyarrow import fs

    system, at = _system(path)
    top = at.rstrip("/") + "/"
    for f in system.get_file_info(fs.FileSelector(at, recursive=recursive)):
        yield f.path.removeprefix(top), f.size if f.is_file else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, file_path, length`` of all files below ``root``, also hidden ones, without reading one; ``file_path`` is relative to it.

    The driver lists the root only; each folder in it is listed by a worker.
    """
    base = root.rstrip("/") + "/"
    top = list(_below(base, False))
    here = spark.createDataFrame([(base + p, p, n) for p, n in top if n is not None], "path string, file_path string, length long")
    folders = spark.createDataFrame([(p,) for p, n in top if n is None], "folder string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder in pdf.folder:
                found = [(f"{base}{folder}/{p}", f"{folder}/{p}", n) for p, n in _below(base + folder, True) if n is not None]
                if found:
                    yield pd.DataFrame(found, columns=["path", "file_path", "length"])

    return here.unionByName(folders.repartition("folder").mapInPandas(run, "path string, file_path string, length long"))


def _read_bytes(path: str) -> bytes:
    system, at = _system(path)
    with system.open_input_stream(at) as f:
        return f.read()


def read_texts(files: DataFrame) -> DataFrame:
    """``files`` with ``content``: the text of every ``path``, null where it is no UTF-8. Only the files of these rows are read."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(len(pdf)):  # one file at a time, as sizes differ
                try:
                    text = _read_bytes(pdf.path.iat[i]).decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                yield pdf.iloc[i : i + 1].assign(content=[text])

    # listed paths come in few partitions; reading is spread
    return files.repartition("path").mapInPandas(run, f"{fields}, content string")


def ignore_rules(files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """Patterns of the ignore files in a ``listing``, outer folders first, with their folder as prefix; they are configuration and come to the driver."""
    name = F.regexp_extract("file_path", r"([^/]+)$", 1)
    found = read_texts(files.where(name.isin(*names))).where("content is not null").select("file_path", "content").collect()
    order = {n: i for i, n in enumerate(names)}
    rules = []
    for row in sorted(found, key=lambda r: (r.file_path.count("/"), r.file_path.rpartition("/")[0], order[r.file_path.rpartition("/")[2]])):
        folder = row.file_path.rpartition("/")[0]
        for line in (x.strip() for x in row.content.split("\n")):
            if not line or line.startswith("#"):
                continue
            back, pattern = ("!", line[1:]) if line.startswith("!") else ("", line)
            if folder:
                inner = pattern.lstrip("/")
                pattern = f"{folder}/{inner}" if "/" in pattern.rstrip("/") else f"{folder}/**/{inner}"
            rules.append(back + pattern)
    return rules


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """``file_path, content, content_hash`` of the files below ``root`` that neither the usual folders, nor ignore files, nor ``ignore`` leave out.

    Paths are relative to ``root``. Paths are listed and filtered before a file is read. Texts that are no UTF-8 become null.
    """
    files = listing(spark, root)
    rules = [*IGNORED, *(ignore_rules(files.where(~ignored(c("file_path"), list(IGNORED))), ignore_files) if ignore_files else []), *(ignore or [])]
    return read_texts(files.where(~ignored(c("file_path"), rules))).select("file_path", "content", F.sha2("content", 256).alias("content_hash"))


def glob_to_regex(pattern: str) -> str:
    """An ignore pattern as a regular expression over relative paths."""
    p = pattern.strip()
    folder = p.endswith("/")
    anchored = "/" in p.rstrip("/")
    p = p.strip("/")
    out = ""
    i = 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches ignores the path; ``!`` takes back, blank lines and ``#`` are skipped."""
    out = F.lit(False)
    for pattern in patterns:
        if not pattern.strip() or pattern.startswith("#"):
            continue
        back = pattern.startswith("!")
        out = F.when(path.rlike(glob_to_regex(pattern.lstrip("!"))), F.lit(not back)).otherwise(out)
    return out


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """``change, file_path, old_path`` of ``diff --name-status`` lines; renames name both paths, other lines are left out."""
    parts = F.split(line, "\t")
    kind = F.create_map(*(F.lit(x) for k, v in {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified"}.items() for x in (k, v)))
    two = F.substring(line, 1, 1).isin("R", "C")
    rows = lines.where(c(line).rlike(r"^[AMDT]\t|^[RC]\d*\t"))
    return rows.select(F.try_element_at(kind, F.substring(line, 1, 1)).alias("change"), F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("file_path"), F.when(two, F.get(parts, F.lit(1))).alias("old_path"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; broken lines are left out one by one."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def to_csv(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``line``: rows as CSV, quoted where needed; null is empty."""
    def cell(name: str) -> Column:
        text = F.coalesce(c(name).cast("string"), F.lit(""))
        return F.when(text.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return rows.select(F.concat_ws(",", *(cell(x) for x in columns)).alias("line"))


def docx_text(data: bytes) -> str | None:
    """Paragraphs of a word-processor file; null for what is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError, EOFError):
        return None
    runs = ("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[\s>].*?</w:p>", xml, re.S))
    text = "\n".join(r for r in runs if r)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(entity, char)
    return text


def pdf_text(data: bytes) -> str | None:
    """Literal strings of uncompressed text blocks; null for what is no PDF."""
    if not data.startswith(b"%PDF"):
        return None
    body, out = data.decode("latin-1"), []
    for block in re.findall(r"BT(.*?)ET", body, re.S):
        shown = re.finditer(r"\(((?:\\.|[^()\\])*)\)\s*Tj|\[((?:[^\]\\]|\\.)*)\]\s*TJ", block)
        words = [m.group(1) if m.group(1) is not None else "".join(re.findall(r"\(((?:\\.|[^()\\])*)\)", m.group(2))) for m in shown]
        out.append("".join(re.sub(r"\\(.)", r"\1", w) for w in words))
    return "\n".join(x for x in out if x)


def office_text(files: DataFrame, path: str = "path", data: str = "content") -> DataFrame:
    """``path, text`` of ``.docx`` and ``.pdf`` files; others and broken ones have null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [docx_text(b) if p.lower().endswith(".docx") else pdf_text(b) if p.lower().endswith(".pdf") else None for p, b in zip(pdf[path], pdf[data])]
            yield pd.DataFrame({"path": pdf[path], "text": read})

    return files.select(path, data).where(c(path).isNotNull() & c(data).isNotNull()).mapInPandas(run, "path string, text string")
