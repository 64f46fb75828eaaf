"""Graphs, budgets, metrics, chunks, texts, sources: literal edge cases."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.operators import analytics, budget, chunking, evaluate, graph, incremental, visual
from lodestrata.sources import benchmarks, connectors, files, manifests

c = F.col


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column).first()[0]


# ---- graph


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "imports"), ("b", "c", "imports"), ("c", "a", "calls"), ("d", "d", "calls"), ("c", "e", "implements"), ("e", "f", "imports"), (None, "a", "imports"), ("", "b", "imports"), ("a", "b", "imports")]
    return spark.createDataFrame(rows, "source string, target string, type string")


def test_bfs(spark, edges):
    seeds = spark.createDataFrame([("a",), ("d",), ("zz",), (None,)], "seed string")
    walk = lambda n: {(r.seed, r.node): r.distance for r in graph.bfs(seeds, edges, n).collect()}
    assert walk(0) == {}
    assert walk(1) == {("a", "b"): 1, ("a", "c"): 1}
    assert walk(2) == {("a", "b"): 1, ("a", "c"): 1, ("a", "e"): 2}
    assert walk(9) == {("a", "b"): 1, ("a", "c"): 1, ("a", "e"): 2, ("a", "f"): 3}


def test_classify(spark):
    nodes = spark.createDataFrame([("1", "x/a.ts", "module"), ("2", "x/a.test.ts", "module"), ("3", "x/b.ts", "module"), ("4", "y/c.ts", "module"), ("5", None, "backlog"), ("6", "z/q.ts", "module")], "id string, file_path string, type string")
    e = spark.createDataFrame([("1", "4", "imports"), ("6", "1", "calls"), ("1", "2", "imports")], "source string, target string, type string")
    pairs = spark.createDataFrame([("1", n) for n in "23456"], "seed string, node string")
    assert {r.node: r.relationship for r in graph.classify(pairs, nodes, e).collect()} == {"2": "test_for", "3": "sibling", "4": "imports", "5": "backlog", "6": "imported_by"}


def test_expand_keeps_the_first_result(spark, edges):
    results = spark.createDataFrame([(0, "a", 1), (0, "e", 2)], "query_id int, node string, rank int")
    got = {r.node: (r.seed, r.distance) for r in graph.expand(results, None, edges).collect()}
    assert got == {"b": ("a", 1), "c": ("a", 1), "f": ("e", 1)}
    assert graph.expand(results, None, edges, max_related=1).count() == 1


def test_resolve_imports(spark):
    known = spark.createDataFrame([("src/a.ts",), ("src/b/index.ts",), ("lib/c.js",), ("src/d.js",), ("src/d.ts",)], "file_path string")
    imports = spark.createDataFrame([("src/x.ts", s) for s in ("./a", "./a.js", "./b", "../lib/c", "./d", "react", "./none", "./../src/./a")], "file_path string, source string")
    assert {r.source: r.target for r in graph.resolve_imports(imports, known).collect()} == {"./a": "src/a.ts", "./a.js": "src/a.ts", "./b": "src/b/index.ts", "../lib/c": "lib/c.js", "./d": "src/d.ts", "./../src/./a": "src/a.ts"}


# ---- budgets and metrics


def test_budget(spark):
    rows = spark.createDataFrame([("q", 1, 5), ("q", 2, 4), ("q", 3, 1), ("p", 1, 99), ("p", 2, 1)], "g string, n int, tokens int")
    take = lambda b, **kw: sorted((r.g, r[1]) for r in budget.fill(rows.withColumnRenamed("n", "pos"), b, ["pos"], ["g"], **kw).collect())
    assert take(8) == [("q", 1)] and take(10) == [("q", 1), ("q", 2), ("q", 3)]
    assert take(0) == [] and take(0, first_always=True) == [("p", 1), ("q", 1)]


def test_metrics(spark):
    runs = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "z", 1), (4, "a", 1), (4, "a", 2)], "query_id int, item_id string, rank int")
    qrels = spark.createDataFrame([(1, "b"), (1, "d"), (1, "b"), (3, "x"), (4, "a")], "query_id int, item_id string")
    got = {r.query_id: r for r in evaluate.ir_metrics(runs, qrels, (2, 0)).collect()}
    assert got[1].p_2 == 0.5 and got[1].r_2 == 0.5 and got[1].mrr == 0.5 and got[1].ap == 0.25 and got[1].ctx_precision == 0.5 and got[1].p_0 == 0
    assert got[2].mrr == 0 and got[2].r_2 == 0 and got[3].ap == 0 and got[3].ndcg == 0
    assert got[4].ndcg > 1  # repeated items count twice


def test_regression_and_curves(spark):
    base = spark.createDataFrame([("m", 0.5), ("z", 0.0)], "metric string, value double")
    now = spark.createDataFrame([("m", 0.47), ("z", 0.3)], "metric string, value double")
    got = {r.metric: r for r in evaluate.regressions(now, base).collect()}
    assert got["m"].regressed and not got["z"].regressed and got["z"].delta_percent == 0
    levels = spark.createDataFrame([("s", 1, 0.1), ("s", 3, 0.5), ("t", 1, 0.0)], "strategy string, budget int, mrr double")
    eff = {r.strategy: r for r in evaluate.efficiency(levels).collect()}
    assert eff["s"].tokens_to_threshold == 3 and abs(eff["s"].auc - 0.3) < 1e-9 and eff["t"].tokens_to_threshold is None and eff["t"].auc == 0 and eff["t"]["rank"] == 2


def test_percentiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert tuple(analytics.percentiles(rows, "v", (0, 50, 95, 100)).first()) == (1.0, 5.0, 10.0, 10.0)
    assert analytics.percentiles(rows.limit(0), "v", (50,)).first()[0] is None


def test_changes_apply_twice(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), (None, "9")], "k string, h string")
    was = spark.createDataFrame([("b", "x"), ("c", None), ("d", "4")], "k string, h string")
    assert {r.k: r.change for r in incremental.detect_changes(now, was, "k", "h").collect()} == {"a": "added", "b": "modified", "c": "unchanged", "d": "deleted"}
    once = incremental.upsert(was, now.where("k is not null"), "k")
    assert sorted(map(str, once.collect())) == sorted(map(str, incremental.upsert(once, now.where("k is not null"), "k").collect()))


# ---- chunks


def test_code_chunks(spark):
    ts = "import x from 'y';\n\nexport class A {\n}\n\nfunction b() {\n}\n"
    rows = spark.createDataFrame([("a.ts", ts), ("e.ts", "  \n"), ("n.ts", None), ("m.py", "x = 1\n"), ("b.txt", "function q() {}")], "file_path string, content string")
    got = sorted((r.file_path, r.start_line, r.end_line, r.chunk_type, r.name) for r in chunking.chunk_code(rows).collect())
    assert got == [("a.ts", 1, 2, "import_block", None), ("a.ts", 3, 5, "class", "A"), ("a.ts", 6, 8, "function", "b"), ("m.py", 1, 2, "module", None)]


def test_oversize_cut():
    text = "\n".join(["aaaaaaaa", "", "bbbbbbbb", "cccccccc", "dddd"])
    parts = chunking.cut_oversize(text, 5)
    assert "".join(p.replace("\n", "") for _, p in parts) == text.replace("\n", "") and [n for n, _ in parts] == sorted(n for n, _ in parts)
    assert chunking.cut_oversize("x" * 100, 5) == [(0, "x" * 100)] and chunking.cut_oversize("  ", 5) == []


def test_markdown(spark):
    text = "intro\n# A\nx\n```py\n# no\n```\n## B\n```\nopen"
    row = spark.createDataFrame([(text,)], "t string").select(chunking.sections(c("t")).alias("s"), chunking.code_blocks(c("t")).alias("b")).first()
    assert [(s.heading, s.level, s.start_line, s.end_line) for s in row.s] == [("", 0, 1, 1), ("A", 1, 2, 4), ("no", 1, 5, 6), ("B", 2, 7, 9)]
    assert [(b.language, b.code) for b in row.b] == [("py", "# no")]
    fm = one(spark, chunking.frontmatter(c("t")), t="---\ntitle: 'X y'\ntags:\n  - a\n  - b\n---\nbody")
    assert (fm.title, fm.tags, fm.body_line) == ("X y", ["a", "b"], 7)
    assert one(spark, chunking.frontmatter(c("t")), t="no front").body_line == 1
    docs = spark.createDataFrame([("d.md", "# T\n\n" + "word \n\n" * 50 + "[[L|x]] #tag"), ("e.md", " "), ("n.md", None)], "file_path string, content string")
    made = chunking.chunk_markdown(docs, max_tokens=30).collect()
    assert len(made) > 3 and {r.file_path for r in made} == {"d.md"} and made[-1].links == ["L"] and made[-1].tags == ["tag"]


def test_python_declarations(spark):
    rows = spark.createDataFrame([("a.py", "class A:\n    def m(self): pass\nasync def f(): pass\n"), ("b.py", "def ("), ("c.py", None)], "file_path string, content string")
    assert sorted((r.name, r.kind) for r in chunking.python_declarations(rows).collect()) == [("A", "class"), ("f", "function")]


# ---- texts and vectors


def test_text_functions(spark):
    assert one(spark, T.token_estimate(c("x")), x="12345") == 2
    assert one(spark, T.html_to_text(c("x")), x="<p>a &amp;lt; b</p><p></p><p></p><br>&#65;&#x1F600;&nbsp;c") == "a < b\n\nA😀 c"
    assert one(spark, T.keywords(c("x")), x="Where is the UserService defined?") == "UserService"
    assert one(spark, T.intent(c("x")), x="who calls foo") == "find_usage" and one(spark, T.intent(c("x")), x=" ") == "general"
    assert [(e.type, e.value) for e in one(spark, T.entities(c("x")), x="is UserService in src/a.ts like parseQuery")] == [("file", "src/a.ts"), ("class", "UserService"), ("function", "parseQuery")]
    assert one(spark, T.wikilinks(c("x")), x="[[a|b]] [[ c ]] [[a]]") == ["a", "c"]
    assert one(spark, T.hashtags(c("x")), x="#a `#b` x#c #d/e") == ["a", "d/e"]
    assert one(spark, T.scan_references(c("x"), "jira"), x="PROJ-1 proj-2 PROJ-1 AB-3") == ["PROJ-1", "AB-3"]
    assert one(spark, T.parse_score(c("x")), x="score: 250") == 100 and one(spark, T.parse_score(c("x")), x="none") == 50
    assert one(spark, T.edit_similarity(c("x"), c("y")), x="", y="") == 1 and one(spark, T.exact_match(c("x"), c("y")), x=" a  b", y="a b")
    assert one(spark, T.valid_id(c("x")), x="a\n") is False and one(spark, T.format_compact(c("x").cast("int")), x="1234") == "1.2K"
    kinds = one(spark, T.js_imports(c("x")), x="import A, { b as c } from 'm';\nimport * as N from \"n\";\nconst q = require('r'); export * from './s'; import('t'); import 'u'")
    assert [(i.kind, i.source, i.names) for i in kinds] == [("default_named", "m", ["A", "b"]), ("namespace", "n", ["N"]), ("side_effect", "u", []), ("dynamic", "t", []), ("require", "r", []), ("reexport_all", "./s", [])]


def test_vectors(spark):
    row = spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), V.l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d"), V.hash_embed(F.lit("x")).alias("e")).first()
    assert row.zero == 0 and row.d == 5 and len(row.e) == 64 and abs(sum(x * x for x in row.e) - 1) < 1e-9


def test_minmax_and_layout(spark):
    rows = spark.createDataFrame([(1, 2.0, 7.0), (2, 4.0, 7.0)], "id int, x double, y double")
    assert [(r.x, r.y) for r in visual.minmax(rows, ["x", "y"]).orderBy("id").collect()] == [(0.0, 0.5), (1.0, 0.5)]
    w = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.5)], "a int, b int, weight double")
    one_, two = (sorted(map(tuple, visual.layout(w, 10).collect())) for _ in range(2))
    assert one_ == two and len(one_) == 3
    with pytest.raises(ValueError):
        visual.layout(w, limit=1)


# ---- sources


def test_scan_and_ignore(spark, tmp_path):
    for name, text in {"src/a.ts": b"x", "node_modules/p/b.js": b"y", "c.log": b"z", "keep.log": b"k", "d.bin": b"\xff\xfe"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text)
    got = {r.file_path: r.content for r in files.scan(spark, str(tmp_path), ["*.log", "!keep.log"]).collect()}
    assert got == {"src/a.ts": "x", "keep.log": "k", "d.bin": None}


def test_parsers(spark):
    lines = spark.createDataFrame([("A\ta",), ("R090\told\tnew",), ("garbage",), ("D\td",)], "line string")
    assert sorted((r.change, r.file_path, r.old_path or "") for r in files.name_status(lines).collect()) == [("added", "a", ""), ("deleted", "d", ""), ("renamed", "new", "old")]
    m = spark.createDataFrame([("r", "{broken")], "repo_name string, content string")
    assert manifests.package_json(m).first().dependencies == []
    assert manifests.go_mod(spark.createDataFrame([("r", "module m\nrequire a/b v1\nrequire (\n\tc/d v2\n)\n")], "repo_name string, content string")).first().dependencies == ["a/b", "c/d"]
    assert [r.line for r in files.to_csv(spark.createDataFrame([('a"b', None), ("c,d", "e")], "x string, y string"), ["x", "y"]).collect()] == ['"a""b",', '"c,d",e']
    entry = '{"repo_name": "r", "file_path": "f", "import_statement": "i", "context": "c", "gold_snippet_code": "g", "cross_file_context": [{"file_path": "p", "code": "g"}, {"file_path": "q", "code": "h"}]}'
    tasks = benchmarks.repobench_entries(spark.createDataFrame([(entry,), ("{",)], "value string")).collect()
    assert [(t.pos, t.is_gold) for t in tasks] == [(0, True), (1, False)]


def test_office_files(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>Hi &amp;</w:t><w:t xml:space='preserve'> you</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p>")
    pdf = b"%PDF-1.4\nBT (Hello \\(x\\)) Tj ET\nBT [(Wo) -3 (rld)] TJ ET"
    rows = spark.createDataFrame([("a.docx", buffer.getvalue()), ("b.pdf", pdf), ("c.docx", b"junk"), ("d.txt", b"x")], "path string, content binary")
    assert {r.path: r.text for r in files.office_text(rows).collect()} == {"a.docx": "Hi & you\nTwo", "b.pdf": "Hello (x)\nWorld", "c.docx": None, "d.txt": None}


def test_connectors(spark, tmp_path):
    lines = ['{"id": "1", "title": "T", "space": "S", "version": 1, "updated_at": "2025-01-01T00:00:00Z", "ancestors": ["A"], "body": "<p>old</p>"}', '{"id": "1", "title": "T", "space": "S", "version": 2, "updated_at": "2025-02-01T00:00:00Z", "ancestors": ["A"], "body": "<p>new</p>"}', "{broken"]
    (tmp_path / "p1.jsonl").write_text("\n".join(lines))
    spark.dataSource.register(connectors.LandedPages)
    raw = spark.read.format("landed_pages").load(str(tmp_path))
    assert raw.count() == 2
    got = connectors.pages(raw).collect()
    assert [(p.path, p.text, p.version) for p in got] == [("confluence/S/A/T", "new", 2)]
    assert connectors.pages(raw, since="2026-01-01").count() == 0


def test_registered_layout_takes_all_epochs(spark, monkeypatch):
    import inspect

    from lodestrata.plans import streams

    layout, seen = visual.layout, []

    def spy(*args, **kw):
        bound = inspect.signature(layout).bind(*args, **kw)
        bound.apply_defaults()
        seen.append(bound.arguments["epochs"])
        return layout(*args, **kw)

    monkeypatch.setattr(visual, "layout", spy)
    streams.umap_layout(spark, "/root/testdata/sf0.001")
    assert seen == [200]
