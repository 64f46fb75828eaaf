"""Generated, minified, vendored and data files among source files.

Every file and every directory is a variable over ``LABELS``. A file's content
and name, and a directory's name, give evidence (log likelihoods); parents,
children and siblings pull each other by compatibilities. The trees are
chains of path prefixes, so one upward and one downward pass of sum-product
messages are exact. Both passes are joins and aggregates per depth: messages
of children are summed with map-side combine, so a directory with a third of
all files is no hot spot, and nothing of the tree reaches the driver.

Copies: bodies (code without leading comments and blanks) that stand under
several repositories, at least once beside a notice of foreign authorship or in a vendor
directory, are evidence for vendored copies wherever they stand. Evidence that is
measured (data, density, copies) weighs as much as the text is long, up to ``FULL`` characters,
so short files have evidence too, and no length decides by itself.

Defined edge cases
    null paths have no tree and are judged by content; null and empty contents
    give no evidence, so the path and its neighbours decide; repeated rows count once; of equal
    beliefs the first label in ``LABELS`` wins (hand-written). Byte-order marks
    and CRLF do not matter. Very long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import salted
from lodestrata.session import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: how surely a file, and a directory, has the label of its parent, by that label; the rest spreads evenly.
#: Vendor directories hold hardly anything else, other directories are mixed.
FILE_TIE = (0.5, 0.5, 0.5, 0.95, 0.5)
DIR_TIE = (0.55, 0.55, 0.55, 0.9, 0.55)

CODE = frozenset("ts tsx js jsx mjs cjs py go java c h cc cpp hpp cs rb rs php kt swift scala css scss sh sql".split())

#: characters of code, and of a body that is a copy, from which measured evidence counts in full; shorter texts' evidence has the weight of their length
FULL, FULL_COPY = 200, 120

# ---- evidence of one file -----------------------------------------------------------------

_lead = re.compile(r"\s*(?:(?:/\*.*?\*/|<!--.*?-->|(?://|#|--)[^\n]*(?:\n|\Z)|package\s+\w+;?[ \t]*\n|['\"]use strict['\"];?)\s*)+", re.S)
_tool = re.compile(
    r"@generated\b|<auto-?generated|auto-?generated\b(?!.{0,40}\bby hand)|\b(?:code|file|source)\s+(?:was\s+)?(?:is\s+)?(?:automatically\s+)?(?:generated|created|produced|emitted|written)\s+(?:automatically\s+)?(?:by|from)\b"
    r"|\bgenerated\s+(?:by|from)\s+\S+|\bdo\s+not\s+(?:edit|modify)\b|\bnot\s+be\s+edited\b|\bautomatically\s+(?:created|generated)\b"
    r"|\bautomatisch\s+(?:erzeugt|generiert)|\bvon\s+\S+\s+(?:erzeugt|generiert)\b|\bg[ée]n[ée]r[ée]e?\s+(?:automatiquement\s+)?par\b|\bgenerado\s+(?:autom[áa]ticamente\s+)?por\b|\bgenerato\s+(?:automaticamente\s+)?da\b|\bgerado\s+(?:automaticamente\s+)?por\b|\bgegenereerd\s+door\b|自動生成|сгенерирован|創り出",
    re.I,
)
_by_hand = re.compile(r"\b(?:by hand|hand-?written|used to|no longer|not generated|instead of generated)\b", re.I)
_foreign = re.compile(
    r"copyright\s*(?:\(c\)|©)?\s*[\d, -]*\s*(?:the\s+)?[\w.@-]+(?:\s+[\w.@-]+)?\s+(?:authors|contributors|working group|project|foundation|maintainers|developers|community)\b"
    r"|\bunder the (?!the project)[\w .-]{2,40} (?:public terms|license|licence)\b|\ba copy of (?!the project)[\w.-]+ to deal\b|^\W*(?!the project)[\w.-]+ is free software\b|\bcopied (?:unchanged )?from (?:the )?upstream\b",
    re.I | re.M,
)
_house = re.compile(r"in-?house|all rights reserved\.?\s*(?:$|\n)|\bof the project\b|\bthe the project\b|\bthe project is free", re.I)
_numbers = re.compile(r"(?<![\w.])(?:[-+]?(?:0x[0-9a-fA-F]++|\d++(?:\.\d++)?(?:e[-+]?\d++)?)[\s,;]++){12,}", re.I)
_encoded = re.compile(r"['\"`]?[A-Za-z0-9+/=_\\-]{56,}['\"`]?")
_drawn = re.compile(r"['\"`][MmLlHhVvCcSsQqTtAaZz\d\s.,-]{56,}['\"`]")
_records = re.compile(r"(?:\{(?:\"?\w+\"?:(?:\"[^\"{}]*\"|[-\d.]+|\[[-\d.,\s]*\]|true|false|null),?\s*)+\},?\s*){4,}")
_inserts = re.compile(r"^INSERT\s+INTO\s[^\n]*$", re.I | re.M)
_integrity = re.compile(r"\bsha\d{3}-[A-Za-z0-9+/=]+")
_pem = re.compile(r"-----BEGIN [^-]+-----.*?-----END [^-]+-----", re.S)
_serial = re.compile(r"(?<=[A-Za-z_])(\d{1,5})(?=\b|_)")
_space = re.compile(r"\s+")


def body(content: str) -> str:
    """The code without byte-order mark, leading comments and white space."""
    text = content.lstrip("﻿")
    lead = _lead.match(text)
    return _space.sub("", text[lead.end() :] if lead else text)


def data_share(text: str) -> float:
    """Share of the text's characters in data literals."""
    rest, total = _integrity.sub("", _pem.sub("", text)), len(text)  # keys and digests are no data of the file
    taken = 0
    for pattern in (_inserts, _records, _drawn, _numbers, _encoded):
        kept = []
        at = 0
        for m in pattern.finditer(rest):
            kept.append(rest[at : m.start()])
            taken += m.end() - m.start()
            at = m.end()
        rest = "".join(kept) + rest[at:] if at else rest
    return taken / max(1, total)


def serial_share(text: str) -> float:
    """Share of the numbered identifiers' numbers that continue a run from 0 or 1 upwards, times their density by line."""
    numbers = [int(x) for x in _serial.findall(text)]
    if len(numbers) < 6:
        return 0.0
    seen = set(numbers)
    run = 0
    start = 0 if 0 in seen else 1
    while start + run in seen:
        run += 1
    if run < 6:
        return 0.0
    lines = sum(1 for line in text.split("\n") if line.strip())
    return min(1.0, sum(1 for n in numbers if n < start + run) / max(1, lines) * 2.0)


def evidence(path: str | None, content: str | None) -> list[float]:
    """Log likelihood of each label, by content and file name."""
    score = dict.fromkeys(LABELS, 0.0)
    score["handwritten"] += 1.0
    name = (path or "").rsplit("/", 1)[-1].lower()
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    code = ext in CODE
    if re.search(r"[.-]min\.(?:js|css)$|\.bundle\.(?:js|css)$|\.[0-9a-f]{8}\.(?:js|css)$", name):
        score["minified"] += 1.0
    if re.search(r"\.pb\.go$|_pb2?\.(?:py|js)$|\.(?:gen|generated)\.\w+$|\.designer\.\w+$", name):
        score["generated"] += 1.0
    if not content or not content.strip():
        return [score[x] for x in LABELS]
    text = content.lstrip("﻿").replace("\r\n", "\n")
    lead = _lead.match(text)
    head, rest = (lead.group(), text[lead.end() :]) if lead else ("", text)
    score["handwritten"] += 2.0
    if head:
        house = bool(_house.search(head))
        if any(_tool.search(line) and not _by_hand.search(line) for line in head.split("\n")):
            score["generated"] += 12.0
        if _foreign.search(head) and not (house and not re.search(r"authors|contributors|working group", head, re.I)):
            score["vendored"] += 12.0
    if not code:
        return [score[x] for x in LABELS]
    n = max(1, len(rest))
    sure = min(1.0, n / FULL)
    share = data_share(rest)
    if share >= 0.5:
        score["blob"] += sure * (4.0 + 8.0 * min(1.0, (share - 0.5) / 0.3))
    blanks = sum(map(rest.count, " \t\n")) / n
    longest = max(map(len, rest.split("\n")))
    lines = rest.count("\n") + 1
    if share < 0.5 and ext in ("js", "ts", "css", "mjs", "cjs", "jsx", "tsx"):
        if blanks < 0.08 and (longest > 1.5 * FULL or n / lines > 0.75 * FULL * sure):
            score["minified"] += 12.0 * sure
        elif blanks < 0.05:
            score["minified"] += 3.0 * sure
    serial = 0.0 if share >= 0.5 or ext in ("css", "scss") else serial_share(rest)
    if serial > 0.25:
        score["generated"] += 4.0 + 8.0 * min(1.0, (serial - 0.25) / 0.35)
    return [score[x] for x in LABELS]


# ---- evidence of names, compatibilities ----------------------------------------------------

#: fixed values: directory names that speak for a label
DIR_NAMES = {
    "vendored": "node_modules bower_components third_party third-party thirdparty vendor vendors vendored godeps extern external externals deps site-packages",
    "generated": "__generated__ generated gen autogen auto_generated codegen_out",
    "minified": "dist min minified bundles",
}
DIR_WEIGHT = {"vendored": 6.0, "generated": 4.0, "minified": 3.0}


def _name_evidence(path: Column) -> list[Column]:
    name = F.lower(F.regexp_extract(path, r"([^/]+)$", 1))
    return [F.when(name.isin(DIR_NAMES[x].split()), F.lit(DIR_WEIGHT[x])).otherwise(F.lit(0.0)) if x in DIR_NAMES else F.lit(0.5 if x == "handwritten" else 0.0) for x in LABELS]


def _shift(beliefs: list[Column]) -> list[Column]:
    top = F.greatest(*beliefs)
    return [F.exp(b - top) for b in beliefs]


def _upward(beliefs: list[Column], keep: tuple[float, ...]) -> list[Column]:
    """What a child with these beliefs tells its parent, by the parent's label."""
    s = _shift(beliefs)
    total = sum(s[1:], s[0])
    return [F.log(F.lit(k) * x + F.lit((1 - k) / len(LABELS)) * total) for x, k in zip(s, keep)]


def _downward(beliefs: list[Column], keep: tuple[float, ...]) -> list[Column]:
    """What a parent with these beliefs tells a child, by the child's label."""
    s = _shift(beliefs)
    spread = [F.lit((1 - k) / len(LABELS)) * x for x, k in zip(s, keep)]
    base = sum(spread[1:], spread[0])
    return [F.log(F.lit(k) * x + base) for x, k in zip(s, keep)]


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(len(LABELS))]


def _named(columns: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def propagate(files: DataFrame) -> DataFrame:
    """Beliefs of files after both passes: ``file_id, path, e0.. -> file_id, path, b0..``; paths split at ``/``."""
    k = range(len(LABELS))
    parent = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise(F.lit(""))
    up = files.where(F.col("path").isNotNull()).select("file_id", "path", parent(F.col("path")).alias("dir"), *[f"e{i}" for i in k], *_named(_upward(_cols("e"), FILE_TIE), "m"))
    up = cut(up)
    # messages of files summed per directory; directories then send theirs, deepest first
    own = cut(up.groupBy("dir").agg(*[F.sum(f"m{i}").alias(f"s{i}") for i in k]).where("dir <> ''").withColumn("depth", F.size(F.split("dir", "/"))))
    deepest = own.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    below: DataFrame | None = None
    for depth in range(deepest, 0, -1):
        here = own.where(F.col("depth") == depth).select("dir", *[f"s{i}" for i in k])
        if below is not None:
            sent = below.select(parent(F.col("dir")).alias("dir"), *_named(_cols("m"), "s"))
            here = here.unionByName(sent).groupBy("dir").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in k])
        with_names = here.select("dir", *_named([a + b for a, b in zip(_cols("s"), _name_evidence(F.col("dir")))], "b"))
        below = cut(with_names.select("dir", *[f"b{i}" for i in k], *_named(_upward(_cols("b"), DIR_TIE), "m")))
        levels[depth] = below
    # downward: what a directory hears from its parent is the parent's belief without its own message
    heard: DataFrame | None = None
    for depth in range(1, deepest + 1):
        here = levels[depth]
        if depth == 1:
            full = here
        else:
            top = heard.select(F.col("dir").alias("up"), *_named(_cols("b"), "p"))
            joined = here.join(top, parent(F.col("dir")) == F.col("up"), "left")
            cavity = [F.coalesce(p, F.lit(0.0)) - m for p, m in zip(_cols("p"), _cols("m"))]
            full = joined.select("dir", *_named([b + c for b, c in zip(_cols("b"), _downward(cavity, DIR_TIE))], "b"))
        heard = cut(full.select("dir", *[f"b{i}" for i in k]))
        levels[depth] = heard
    every = None
    for found in levels.values():
        every = found if every is None else every.unionByName(found)
    if every is None:
        return files.select("file_id", "path", *_named(_cols("e"), "b"))
    dirs = every.select("dir", *_named(_cols("b"), "d"))
    files_of, beliefs_of = salted(up, dirs, "dir", "file_id")
    joined = files_of.join(beliefs_of, ["dir", "salt"], "left")
    cavity = [F.coalesce(d, F.lit(0.0)) - F.when(F.col("d0").isNull(), F.lit(0.0)).otherwise(m) for d, m in zip(_cols("d"), _cols("m"))]
    done = joined.select("file_id", "path", *_named([e + c for e, c in zip(_cols("e"), _downward(cavity, FILE_TIE))], "b"))
    return done.unionByName(files.where(F.col("path").isNull()).select("file_id", "path", *_named(_cols("e"), "b")))


# ---- the operator ------------------------------------------------------------------------------


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for pdf in batches:
        found = [evidence(p, c) for p, c in zip(pdf.path, pdf.content)]
        out = pdf[["file_id", "path"]].assign(**{f"e{i}": [f[i] for f in found] for i in range(len(LABELS))})
        bodies = [body(c) if c else "" for c in pdf.content]
        yield out.assign(copy=[hashlib.md5(b.encode("utf-8", "surrogatepass")).hexdigest() if b else None for b in bodies], weight=[min(1.0, len(b) / FULL_COPY) for b in bodies])


def label_files(files: DataFrame, *, file_id: str = "file_id", path: str = "file_path", content: str = "content") -> DataFrame:
    """``file_id, path, label, p`` for every distinct file; ``p`` is the belief in the label."""
    k = range(len(LABELS))
    kind = dict(files.dtypes)[file_id]
    rows = files.select(F.col(file_id).alias("file_id"), F.col(path).alias("path"), F.col(content).alias("content"))
    fields = ", ".join(f"e{i} double" for i in k)
    # hashing keeps the shuffle of distinct rows free of contents
    seen = cut(rows.mapInPandas(_evidence, f"file_id {kind}, path string, {fields}, copy string, weight double").distinct())
    vendored = LABELS.index("vendored")
    in_vendor = F.exists(F.split(F.lower("path"), "/"), lambda x: x.isin(DIR_NAMES["vendored"].split()))
    repo = F.substring_index("path", "/", 1)
    copies = (
        seen.where(F.col("copy").isNotNull())
        .groupBy("copy")
        .agg(F.min(repo).alias("first"), F.max(repo).alias("last"), F.max((in_vendor | (F.col(f"e{vendored}") > 5)).cast("int")).alias("foreign"))
        .where("first <> last and foreign = 1")
        .select("copy", F.lit(5.0).alias("bonus"))
    )
    # rows without a body get keys of their own, as nulls would meet in one task
    keyed = seen.withColumn("copy", F.coalesce("copy", F.concat(F.lit("~"), F.col("file_id").cast("string"))))
    left, right = salted(keyed, copies, "copy", "file_id")
    scored = left.join(right, ["copy", "salt"], "left").withColumn(f"e{vendored}", F.col(f"e{vendored}") + F.coalesce(F.col("bonus") * F.col("weight"), F.lit(0.0)))
    beliefs = propagate(scored.select("file_id", "path", *[f"e{i}" for i in k]))
    best = F.greatest(*_cols("b"))
    label = F.lit(LABELS[-1])
    for i in reversed(k[:-1]):
        label = F.when(F.col(f"b{i}") == best, F.lit(LABELS[i])).otherwise(label)
    total = sum((F.exp(b - best) for b in _cols("b")), F.lit(0.0))
    return beliefs.select("file_id", "path", label.alias("label"), (F.lit(1.0) / total).alias("p"))


def not_handwritten(files: DataFrame, **kw) -> DataFrame:
    """Distinct ids of the files that are not hand-written."""
    return label_files(files, **kw).where(F.col("label") != LABELS[0]).select("file_id").distinct()
