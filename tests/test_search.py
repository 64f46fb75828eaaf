"""Lexical and vector search: edge cases, properties, plans."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import fusion, lexical


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, None), (4, "  "), (5, "alphabet soup"), (6, "beta gamma")], "id int, text string")


def run(spark, docs, text, **kw):
    queries = spark.createDataFrame([(0, text)], "query_id int, text string")
    return [(r.doc_id, r["rank"]) for r in lexical.bm25(queries, lexical.build_postings(docs, "id", {"content": "text"}), **kw).orderBy("rank").collect()]


def test_bm25_edges(spark, docs):
    assert [d for d, _ in run(spark, docs, "beta")] == [1, 2, 6]  # ties by id
    assert run(spark, docs, "") == [] and run(spark, docs, None) == [] and run(spark, docs, "zzz") == []
    assert run(spark, docs, "beta", k=0) == [] and len(run(spark, docs, "beta", k=99)) == 3
    assert run(spark, docs.limit(0), "beta") == []
    assert run(spark, docs, "beta beta BETA") == run(spark, docs, "beta")


def test_prefix_and_fuzzy(spark, docs):
    assert {d for d, _ in run(spark, docs, "alpha")} == {1}
    assert {d for d, _ in run(spark, docs, "alpha", prefix=True)} == {1, 5}
    assert {d for d, _ in run(spark, docs, "gamna")} == set() and {d for d, _ in run(spark, docs, "gamna", fuzzy=True)} == {2, 6}
    assert run(spark, docs, "alpha", prefix=True)[0][0] == 1  # the exact term weighs more


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def rounded(x):
    return int(x + 0.5)


@pytest.mark.parametrize("kind", ["prefix", "fuzzy"])
def test_whole_texts_are_expanded(spark, tmp_path, kind):
    """The registered queries against brute force: terms of a text that its path lacks are expanded too."""
    from lodestrata.plans import catalog
    from lodestrata.plans.search import FIELDS

    texts = {0: "index the token walker", 1: "tokens are indexed", 2: "indes tokan", 3: "walkers walked", 50: "Token walk indexe", 51: None}
    rows = [(i, t, f"repo/x{i}.md", "wiki", "r", "en") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc_path string, source string, repo_name string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    post = lexical.build_postings(docs, "doc_id", FIELDS)
    vocabulary = {r.term for r in post.select("term").distinct().collect()}
    near = (lambda q, v: len(q) >= 3 and v.startswith(q)) if kind == "prefix" else (lambda q, v: len(v) >= 2 and edits(q, v) <= rounded(len(q) * 0.2))
    weight = {"prefix": 0.375, "fuzzy": 0.45}[kind]
    asked = {}
    for i in (0, 50):
        for q in texts[i].lower().split():
            asked[i, q] = 1.0
            for v in vocabulary - {q}:
                if near(q, v):
                    asked[i, v] = max(asked.get((i, v), 0), weight)
    want = lexical.top(lexical.score(spark.createDataFrame([(i, t, w) for (i, t), w in asked.items()], "query_id bigint, term string, weight double"), post), 10)
    got = catalog.registry().fns[f"bm25_{kind}_text"](spark, str(tmp_path))
    assert len(asked) > 7 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fuzzy_allows_the_whole_share_of_long_terms(spark):
    """Every term against brute force, with 1 to 7 edits allowed."""
    import random

    rng = random.Random(5)
    words = set()
    for n in (2, 3, 7, 8, 12, 13, 14, 17, 18, 22, 23, 35):
        for _ in range(3):
            base = "".join(rng.choice("abc") for _ in range(n))
            words.add(base)
            for e in range(1, 9):
                w = base
                for _ in range(e):
                    i = rng.randrange(len(w) + 1)
                    w = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]))
                words.add(w)
    words = sorted(w for w in words if w)
    post = spark.createDataFrame([(w,) for w in words], "term string")
    asked = spark.createDataFrame([(1, w, 1.0) for w in words], "query_id int, term string, weight double")
    asked = asked.withColumn("query_id", F.dense_rank().over(Window.orderBy("term")) - 1)
    got = {(words[r.query_id], r.term) for r in lexical.expand_fuzzy(asked, post).collect()}
    want = {(q, v) for q in words for v in words if q == v or len(v) >= 2 and edits(q, v) <= rounded(len(q) * 0.2)}
    assert any(edits(q, v) >= 5 for q, v in want) and got == want


def test_boosts_and_update(spark):
    rows = spark.createDataFrame([(1, "x", "rare"), (2, "rare", "x")], "id int, body string, title string")
    post = lexical.build_postings(rows, "id", {"content": "body", "summary": "title"})
    q = spark.createDataFrame([(0, "rare")], "query_id int, text string")
    assert [r.doc_id for r in lexical.bm25(q, post).orderBy("rank").collect()] == [1, 2]
    gone = spark.createDataFrame([(1,)], "doc_id int")
    once = lexical.update_postings(post, gone, post.where("doc_id = 2"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, post.where("doc_id = 2").collect()))


def vec(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, v array<float>")


def test_vector_topk_edges(spark):
    rows = vec(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 1.0, 1.0])])
    q = vec(spark, [(1, [2.0, 0.0]), (9, [0.0, 0.0])]).withColumnRenamed("doc_id", "query_id")
    top = lambda **kw: {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in fusion.vector_topk(q, rows, **kw).collect()}
    got = top(k=3)
    assert got[1, 1] == (1, 1.0) and got[1, 2] == (2, 1.0) and got[1, 3] == (3, 0.0) and got[9, 1] == (1, 0.0)
    assert top(k=0) == {} and len(top(k=50)) == 8
    assert top(k=3, tiles=3) == got
    assert (1, 1) in top(k=1, exclude_self=True) and top(k=1, exclude_self=True)[1, 1] == (2, 1.0)
    l2 = {(r.query_id, r["rank"]): r.doc_id for r in fusion.vector_topk(q, rows, 4, "l2").collect()}
    assert l2[1, 1] == 1 and l2[9, 1] == 4
    assert fusion.vector_topk(q, rows.limit(0), 3).count() == 0 and fusion.vector_topk(q.limit(0), rows, 3).count() == 0
    assert {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in fusion.vector_topk(q, rows, 3, tiles=40).collect()} == got


def test_topk_grows_with_k_and_keeps_order(spark):
    rows = vec(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)])
    q = rows.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    five = {tuple(r) for r in fusion.vector_topk(q, rows, 5).collect()}
    ten = {tuple(r) for r in fusion.vector_topk(q, rows.repartition(7), 10, tiles=4).collect()}
    assert five <= ten


def test_rrf(spark):
    one = spark.createDataFrame([(0, 10, 1), (0, 11, 2)], "query_id int, doc_id int, rank int")
    two = spark.createDataFrame([(0, 11, 1), (0, 12, 2)], "query_id int, doc_id int, rank int")
    got = {r.doc_id: (r.score, r["rank"]) for r in fusion.rrf(one, two, 10).collect()}
    assert got[11] == (round(0.7 / 62 + 0.3 / 61, 9), 1) and got[10][1] == 2 and got[12][1] == 3
    assert fusion.rrf(one.limit(0), two.limit(0)).count() == 0
    assert [r.doc_id for r in fusion.rrf(one, two, 1).collect()] == [11]


def test_rerank(spark):
    rows = spark.createDataFrame([(0, i, i, s) for i, s in enumerate([5, 9, 9, 1, 100], 1)], "query_id int, doc_id int, rank int, model_score int")
    order = [r.doc_id for r in fusion.rerank(rows, top_n=3).orderBy("new_rank").collect()]
    assert order == [2, 3, 1, 4, 5]


def test_plans_have_no_cartesian_product(spark, docs):
    q = spark.createDataFrame([(0, "beta")], "query_id int, text string")
    plan = lexical.bm25(q, lexical.build_postings(docs, "id", {"content": "text"}))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x")], "id int, lang string, body string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(F.col("lang") == "a").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,a)]" in plan and "body" not in plan
