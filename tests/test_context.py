"""Context assembly, recall, the manifest scorer, explanations, scans with ignore files, visibility."""

import random

from pyspark.sql import functions as F

from lodestrata.operators import analytics, budget, chunking, evaluate, incremental, manifest
from lodestrata.sources import connectors, files


def test_sections_and_their_shares(spark):
    primary = spark.createDataFrame([(1, "a", "x = 1", 2.0, "f", "function", "src/a.py", 3, 4, "sum"), (1, "b", "y" * 400, 1.0, None, None, None, None, None, ""), (2, "c", "z", 1.0, "", "k", "", 1, 1, None)], "query_id int, id string, text string, score double, name string, chunk_type string, file_path string, start_line int, end_line int, summary string")
    related = spark.createDataFrame([(1, "r", "imp", 1, "g", "imports", "src/b.py", None)], "query_id int, id string, text string, distance int, name string, relationship string, file_path string, summary string")
    graph = spark.createDataFrame([(1, ["src/a.py", "src/b.py"], [("src/a.py", "src/b.py", "imports")]), (2, [], [])], "query_id int, nodes array<string>, edges array<struct<source:string,target:string,type:string>>")
    got = {r.query_id: r for r in budget.assemble(primary, related, graph, max_tokens=300, reserve=100).collect()}
    assert got[1].content == (
        "## Primary Results\n\n### f (function)\nFile: src/a.py [L3-4]\nsum\n```\nx = 1\n```\n"
        "## Related Context\n\n### g [imports, distance=1]\nFile: src/b.py\n```\nimp\n```\n"
        "## Dependency Graph\n\nNodes: src/a.py, src/b.py\nsrc/a.py --[imports]--> src/b.py"
    )
    assert (got[1].n_primary, got[1].n_related, got[1].has_graph, got[1].truncated) == (1, 1, True, True)
    assert got[2].content == "## Primary Results\n\n### (unnamed chunk)\n```\nz\n```" and not got[2].truncated and not got[2].has_graph
    small = {r.query_id: r for r in budget.assemble(primary, related, graph, max_tokens=100, reserve=0).collect()}
    assert not small[1].has_graph and small[1].truncated
    none = budget.assemble(primary.limit(0), related.limit(0), graph.limit(0))
    assert none.count() == 0


def test_context_recall(spark):
    expected = spark.createDataFrame([(1, "The Cat sat", "cat"), (1, "The Cat sat", "dog"), (2, None, "x"), (3, "", "y"), (4, "a", None)], "query_id int, text string, info string")
    contexts = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "query_id int")
    got = {r.query_id: r.context_recall for r in evaluate.context_recall(expected, contexts).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0, 4: None, 5: None}


def points(query, name, module, description, path):
    import re

    words = lambda s: [w for w in re.sub("[^a-z0-9]+", " ", s).split(" ") if w]
    q, name, module, description, path = (x.lower() for x in (query, name, module, description, path))
    total = 10 * (len(name) > 2 and name in q) + 3 * (bool(module) and module in q)
    total += 7 * sum(len(p) > 2 and p in q for p in name.split(".")) if "." in name else 0
    for a in words(q):
        for b in words(name):
            total += 5 * (len(a) > 2) if a == b else 2 * ((a in b and len(a) > 3) or (b in a and len(b) > 3))
        total += sum(a == b for b in words(description) + words(path)) if len(a) > 3 else 0
    return total


def test_manifest_points_equal_brute_force(spark):
    rng = random.Random(6)
    pool = ["user", "users", "userStore", "get", "io", "auth", "authenticate", "a", "store.get", "parse_config", "Xyz", "configuration", ""]
    say = lambda n, sep=" ": sep.join(rng.choice(pool) for _ in range(n))
    queries = [(i, say(rng.randint(0, 9))) for i in range(40)] + [(99, None)]
    entities = [(f"e{i}", say(rng.randint(1, 3), rng.choice(["", ".", "_"])), rng.choice(pool), say(3), say(2, "/")) for i in range(60)]
    got = {(r.query_id, r.id): r.score for r in manifest.score(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(entities + entities[:5] + [("n", None, None, None, None)], "id string, name string, module string, description string, path string")).collect()}
    want = {(q, e[0]): p for q, t in queries if t is not None for e in entities if (p := points(t, *e[1:])) > 0}
    assert got == want


def test_explain(spark):
    rows = spark.createDataFrame([("1", "Foo", "a/x.py", 1, 2, "class", "s", "c"), ("2", None, "a/x.py", None, None, None, None, None), ("3", "bar", "b.py", 1, 1, "function", "s", "c")], "id string, name string, file_path string, start_line int, end_line int, chunk_type string, nl_summary string, content string")
    assert [r.id for r in analytics.explain(rows, name="foo").collect()] == ["1"]
    assert sorted(r.id for r in analytics.explain(rows, path="a/").collect()) == ["1", "2"]
    assert [r.id for r in analytics.explain(rows, path="a/", k=1, detailed=True).collect()] == ["2"]
    assert analytics.explain(rows).count() == 0 and "content" not in analytics.explain(rows, name="x").columns


def test_scan_reads_only_what_is_left(spark, tmp_path):
    for name, text in {"a.py": "x", "node_modules/m.js": "m", "b/c.log": "l", "b/keep.log": "k", "b/.gitignore": "*.log\n!keep.log\n/only\n# note\n", "b/only": "o", "b/d/only": "o", ".gitignore": "*.tmp\n", "z.tmp": "t", "b/z.tmp": "t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"\xff\xfe")
    (tmp_path / "b" / "locked.log").mkdir()
    found = {r.file_path: r.content for r in files.scan(spark, str(tmp_path)).collect()}
    assert found == {"a.py": "x", "b/keep.log": "k", "b/.gitignore": "*.log\n!keep.log\n/only\n# note\n", "b/d/only": "o", ".gitignore": "*.tmp\n", "bin.dat": None}
    (tmp_path / "c.tmp").symlink_to(tmp_path / "nowhere")  # what is left out is not opened
    assert "c.tmp" not in {r.file_path for r in files.scan(spark, str(tmp_path)).collect()}
    assert {r.file_path for r in files.scan(spark, str(tmp_path), ["*.py"], ignore_files=()).collect()} >= {"b/c.log", "z.tmp"}


def test_rows_without_repository_stand_once(spark):
    rows = spark.createDataFrame([("1", "r"), ("2", "r"), ("3", None), ("4", "s"), ("5", "t")], "id string, repo_name string")
    grants = spark.createDataFrame([("u", "r"), ("u", "s"), ("v", "s"), ("w", "none")], "user_id string, repo string")
    got = sorted((r.user_id or "", r.id) for r in analytics.visible(rows, grants).collect())
    assert got == [("", "3"), ("u", "1"), ("u", "2"), ("u", "4"), ("v", "4")]
    assert {r.user_id: r.n for r in analytics.visible_counts(rows, grants).collect()} == {"u": 4, "v": 2, "w": 1}
    assert {r.user_id: r.n for r in analytics.visible_counts(rows, grants, null_repo="deny").collect()} == {"u": 3, "v": 1}
    plan = analytics.visible(rows, grants)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_upserts_do_not_depend_on_order(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "id string, n int, t string")
    for some in (df, df.orderBy(F.desc("n"))):
        assert sorted(tuple(r) for r in incremental.upsert(df.limit(0), some, "id").collect()) == [("a", 2, "y"), ("b", 1, None)]


def test_declarations_of_real_snippets(spark):
    cases = {
        "rust": ("pub(crate) unsafe fn go() {}\nconst MAX: u8 = 3;\nimpl<T: Clone> Stack<T> {\ntype Row = u8;\nconst fn k() {}\nlet x = 1;\n// fn no\nmacro_rules! my {\n", ["go", "MAX", "Stack", "Row", "k", "my"]),
        "c_sharp": ("using System;\nnamespace A.B;\npublic static partial class Foo\n{\n    public enum Kind { A }\n    public int X;\n}\n", ["A.B", "Foo", "Kind"]),
        "c": ("#define X 1\nint main(int argc, char **argv) {\n  return go(1);\n}\nstatic struct node *head = 0;\nenum kind { A };\nreturn x;\nunsigned long long f(void);\n", ["main", "head", "kind", "f"]),
        "cpp": ("#include <a>\nusing namespace std;\nclass Foo final : public Bar {\n};\nFoo::~Foo() {}\nstd::map<int, int> Foo::all(int x) const {\nenum class Kind { A };\n", ["Foo", "Foo::~Foo", "Foo::all", "Kind"]),
        "ruby": ("class A::B < C\n  def inner; end\nend\ndef save!\nend\nx = 1\n", ["A::B", "save!"]),
        "php": ("<?php\nabstract class A {\n  function m() {}\n}\ntrait T {}\nfunction &f() {}\n$x = 1;\n", ["A", "T", "f"]),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "language string, content string")
    got = {r.language: [x.name for x in r.d] for r in df.select("language", chunking.declarations(F.col("content"), F.col("language")).alias("d")).collect()}
    assert got == {k: names for k, (_, names) in cases.items()}


def test_landed_pages_as_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "p1.json").write_text('{"id": "1"}\nbroken\n[1]\n')
    spark.dataSource.register(connectors.LandedPages)
    for name, text in (("p2.json", '{"id": "2"}\n'), ("p3.json", '{"id": "3"}\n{"id": "4"}\n')):
        (folder / name).write_text(text)
        query = spark.readStream.format("landed_pages").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2", "3", "4"]
    assert spark.read.format("landed_pages").load(str(folder)).count() == 4


def test_a_stored_index_reads_the_buckets_of_asked_terms(spark, tmp_path):
    from lodestrata.operators import lexical

    docs = spark.createDataFrame([(i, f"w{i % 7} common w{i}") for i in range(200)] + [(999, None)], "id int, t string")
    postings = lexical.build_postings(docs, "id", {"content": "t"})
    folder = str(tmp_path / "index")
    lexical.write_index(postings, folder, buckets=16)
    queries = spark.createDataFrame([(1, "w3"), (2, "w150 w3")], "query_id int, text string")
    got = lexical.bm25_stored(queries, folder, 5, id_type="int")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25(queries, postings, 5).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "doc_id" in line]
    assert scans and all("PartitionFilters: [" in x and "bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    assert lexical.bm25_stored(queries.limit(0), folder, 5, id_type="int").count() == 0
    lexical.write_index(postings.limit(0), str(tmp_path / "none"))
    assert lexical.bm25_stored(queries, str(tmp_path / "none"), 5, id_type="int").count() == 0


def test_enrichment_resumes_and_stops(spark, tmp_path):
    import pytest

    from lodestrata.operators import providers

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(3, "text 3"), (90, None), (91, " ")], "id int, t string")
    folder = str(tmp_path / "summaries")

    def refuse(texts):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="3 batches"):
        providers.enrich(rows, "id", "t", refuse, folder, batch_rows=5)

    def some(texts):
        if any(t.endswith("7") for t in texts):
            raise RuntimeError("no sevens")
        return [t.upper() for t in texts]

    got = {r.id: r.summary for r in providers.enrich(rows, "id", "t", some, folder, batch_rows=20, batch=1).collect()}
    assert got == {i: f"TEXT {i}" for i in range(40) if i % 10 != 7}
    seen = tmp_path / "asked"

    def note(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return ["x"] * len(texts)

    assert len(providers.enrich(rows, "id", "t", note, folder).collect()) == 40
    assert sorted(seen.read_text().split("\n")[:-1]) == sorted(f"text {i}" for i in (7, 17, 27, 37))


def test_rerank_by_a_model(spark):
    from lodestrata.operators import providers

    found = spark.createDataFrame([(1, d, r, "q", t) for d, r, t in (("a", 1, "10"), ("b", 2, "fail"), ("c", 3, "95"), ("d", 4, "100"))], "query_id int, doc_id string, rank int, query string, text string")

    def model(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("x")
        return ["Score: " + p.split("Text:\n")[1].split("\n")[0] for p in prompts]

    got = sorted((r.new_rank, r.doc_id, r.model_score) for r in providers.rerank(found, model, top_n=3, batch=1).collect())
    assert [g[1] for g in got] == ["c", "b", "a", "d"] and [g[2] for g in got] == [95, 50, 10, None]


def test_site_pages(spark):
    line = '{"id": "p", "title": "T", "webUrl": "u", "lastModifiedDateTime": "2025-0%d-01T00:00:00Z", "webParts": [{"innerHtml": "<p>v%d &amp; x</p>"}, {"data": {"title": "A", "description": "b"}}, {}]}'
    rows = connectors.site_pages(spark.createDataFrame([(line % (1, 1),), (line % (2, 2),), ("{",)], "value string")).collect()
    assert [(r.page_id, r.title, r.url, r.text) for r in rows] == [("p", "T", "u", "v2 & x\n\nA b")]
    assert connectors.site_pages(spark.createDataFrame([(line % (1, 1),)], "value string"), since="2025-02-01").count() == 0


def test_reports(spark):
    from lodestrata.sources import reports

    metrics = spark.createDataFrame([("q1", 0.2, 1.0), ("q|2", 0.4, None)], "query_id string, p_5 double, mrr double")
    lines = [r.line for r in reports.markdown(metrics, "d", "2025-01-01").orderBy("part", "key").collect()]
    assert lines[4] == "**Queries**: 2" and "| Precision@5 | 0.3000 |" in lines and "| Context Recall | N/A |" in lines and lines[-2:] == ["| q1 | 0.2000 | N/A | 1.0000 | N/A | N/A |", "| q 2 | 0.4000 | N/A | N/A | N/A | N/A |"]
    assert [r.line for r in reports.json_lines(metrics).collect()][1] == '{"query_id":"q|2","p_5":0.4,"mrr":null}'
    assert len(reports.markdown(metrics.limit(0), "d", "x").collect()) == 24
