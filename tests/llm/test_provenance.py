"""Kinds of files by evidence and belief propagation."""

import itertools
import math
import random

from pyspark.sql import functions as F

from lodestrata.llm import provenance as P

HAND = "import os\n\ndef load(path):\n    with open(path) as f:\n        return [line.strip() for line in f if line]\n\n\ndef main():\n    for row in load('x'):\n        print(row.upper())\n"


def top(path, content):
    e = P.evidence(path, content)
    return P.LABELS[e.index(max(e))]


def test_evidence():
    numbered = "".join(f"export function encodeA{i}(w) {{\n  w.tag({i}).string(m.a_{i});\n}}\n" for i in range(30))
    assert top("a/x.py", HAND) == "handwritten"
    assert top("a/x.py", "# Code generated by foo. DO NOT EDIT.\n" + HAND) == "generated"
    assert top("a/x.js", "const HEADER = 'Code generated by foo. DO NOT EDIT.'\n" + HAND) == "handwritten"
    assert top("a/x.py", "# We used to keep a generated client here; it is written by hand since the move.\n" + HAND) == "handwritten"
    assert top("a/x.ts", numbered) == "generated"
    assert top("a/x.js", "function a(b,c){return b?c.d:a(c)}" * 40) == "minified"
    assert top("a/x.py", "// Copyright (c) 2019 Foo Authors\n// Foo is free software\n" + HAND) == "vendored"
    assert top("a/x.py", "# Copyright (c) 2019 the foo team, in-house code\n# All rights reserved.\n" + HAND) == "handwritten"
    assert top("a/x.py", "W = [\n" + "0.123, -4.5, " * 200 + "]\n") == "blob"
    assert top("a/x-min.py", HAND) == "handwritten"
    assert P.evidence(None, None)[0] == 1.0


def test_short_files_have_evidence_and_time_is_linear():
    import time

    assert top("a/x.py", "W = [" + "0.123, -4.5, " * 12 + "]\n") == "blob"
    assert top("a/x.js", "function a(b,c){return b?c.d:a(c)}" * 5) == "minified"
    weight = [P.evidence("a/x.js", "function a(b,c){return b?c.d:a(c)}" * n)[2] for n in (1, 2, 3, 4, 5, 6)]
    assert weight == sorted(weight) and weight[0] > 0
    for unit in ("7", "1 ", "1,a", "{a:1,", "'M1 ", "0x", "// copyright ", "a1 "):
        began = time.process_time()
        P.evidence("a/x.js", unit * (200_000 // len(unit)))
        assert time.process_time() - began < 2.0


def test_short_copies_count(spark):
    rows = [(1, "r/node_modules/p/b.js", "exports.add = (a, b) => a + b; exports.sub = (a, b) => a - b;"), (2, "r2/node_modules/p/c.js", "exports.add = (a, b) => a + b; exports.sub = (a, b) => a - b;"), (3, "r3/x/c.js", "exports.add = (a, b) => a + b; exports.sub = (a, b) => a - b;"), (4, "r3/x/d.js", "")]
    df = spark.createDataFrame(rows, "file_id bigint, file_path string, content string")
    alone = df.where("file_id > 2")
    p = {r.file_id: r.p for r in P.label_files(df).collect()}
    assert {r.file_id: r.p for r in P.label_files(alone).collect()}[3] > p[3]


def exact(files):
    """Beliefs by summing over all labellings of a small tree."""
    dirs = sorted({"/".join(p.split("/")[:i]) for p, _ in files for i in range(1, len(p.split("/")))})
    n, k = len(P.LABELS), len(dirs)
    tie = lambda keep, child, parent: keep[parent] * (child == parent) + (1 - keep[parent]) / n
    name = lambda d: [math.exp(P.DIR_WEIGHT[x]) if x in P.DIR_NAMES and d.split("/")[-1] in P.DIR_NAMES[x].split() else math.exp(0.5) if x == "handwritten" else 1.0 for x in P.LABELS]
    totals = [[0.0] * n for _ in files]
    for labels in itertools.product(range(n), repeat=k):
        at = dict(zip(dirs, labels))
        w = math.prod(name(d)[at[d]] for d in dirs) * math.prod(tie(P.DIR_TIE, at[d], at[d.rsplit("/", 1)[0]]) for d in dirs if "/" in d)
        sums = [[math.exp(e[i]) * tie(P.FILE_TIE, i, at[p.rsplit("/", 1)[0]]) for i in range(n)] for p, e in files]
        rest = [sum(s) for s in sums]
        whole = w * math.prod(rest)
        for f in range(len(files)):
            for i in range(n):
                totals[f][i] += whole / rest[f] * sums[f][i]
    return [[x / sum(t) for x in t] for t in totals]


def test_propagation_is_exact(spark):
    rng = random.Random(4)
    paths = ["r/a/1", "r/a/2", "r/vendor/3", "r/vendor/x/4", "r/5"]
    files = [(p, [round(rng.uniform(-2, 2), 3) for _ in P.LABELS]) for p in paths]
    df = spark.createDataFrame([(i, p, *e) for i, (p, e) in enumerate(files)], "file_id bigint, path string, " + ", ".join(f"e{i} double" for i in range(len(P.LABELS))))
    got = {r.file_id: [r[f"b{i}"] for i in range(len(P.LABELS))] for r in P.propagate(df).collect()}
    for i, want in enumerate(exact(files)):
        top_, total = max(got[i]), 0.0
        shares = [math.exp(x - top_) for x in got[i]]
        total = sum(shares)
        assert all(abs(s / total - w) < 1e-9 for s, w in zip(shares, want))


def test_operator_edges(spark):
    gen = "# @generated by tool\n" + HAND
    rows = [(1, "r/a.py", HAND), (1, "r/a.py", HAND), (2, "r/node_modules/p/b.js", (HAND * 2).replace("load", "q")), (3, None, gen), (4, "x.py", None), (5, "r/dist/e.js", ""), (6, "solo.py", gen), (7, "r2/lib/p/c.js", (HAND * 2).replace("load", "q"))]
    df = spark.createDataFrame(rows, "file_id bigint, file_path string, content string").selectExpr("*", "file_id as path", "content as label", "1 as e0")
    got = {r.file_id: r.label for r in P.label_files(df).collect()}
    assert got[1] == "handwritten" and got[2] == "vendored" and got[3] == "generated" and got[6] == "generated" and got[4] == "handwritten"
    assert got[7] == "vendored"  # a copy of what stands in a vendor directory elsewhere
    assert len(P.label_files(df).collect()) == 7
    assert P.not_handwritten(df.limit(0)).count() == 0


def test_deep_directories_are_heard(spark):
    path = "r/" + "d/" * 64 + P.DIR_NAMES["generated"].split()[0] + "/x.js"
    df = spark.createDataFrame([(1, path, *[0.0] * len(P.LABELS))], "file_id bigint, path string, " + ", ".join(f"e{i} double" for i in range(len(P.LABELS))))
    row = P.propagate(df).first()
    beliefs = [row[f"b{i}"] for i in range(len(P.LABELS))]
    assert P.LABELS[beliefs.index(max(beliefs))] == "generated"


def test_copies_in_any_two_repositories(spark):
    """Also in two whose names an estimate of distinct values takes for one."""
    pairs = spark.range(8000).selectExpr("id", "explode(array('a', 'b')) as side").selectExpr("id", "concat('r', id, side) as repo")
    pair = pairs.groupBy("id").agg(F.approx_count_distinct("repo").alias("n")).where("n = 1").orderBy("id").first().id
    content = (HAND * 2).replace("load", "q")
    rows = [(1, f"r{pair}a/node_modules/p/b.js", content), (2, f"r{pair}b/lib/p/c.js", content)]
    df = spark.createDataFrame(rows, "file_id bigint, file_path string, content string")
    assert {r.file_id: r.label for r in P.label_files(df).collect()} == {1: "vendored", 2: "vendored"}
