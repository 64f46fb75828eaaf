"""The engine end to end: index, search, re-index, context, providers."""

import pytest

from lodestrata.engine import Engine
from lodestrata.operators import providers

FILES = {
    "src/auth.ts": "import { hash } from './hash';\n\nexport class AuthService {\n  login(user) { return hash(user); }\n}\n",
    "src/hash.ts": "export function hash(text) {\n  return text.length;\n}\n",
    "docs/guide.md": "# Guide\n\nHow to log in.\n\n## Tokens\n\nTokens expire after an hour.\n",
    "blank.ts": "  \n",
    "none.ts": None,
}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "file_path string, content string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("index") / "i"))
    assert e.generation() == 0
    assert {r.change: r.n for r in e.index(frame(spark, FILES)).collect()} == {"added": 5}
    return e


def test_search_and_filters(spark, engine):
    q = spark.createDataFrame([(1, "AuthService login"), (2, "tokens expire")], "query_id int, text string")
    rows = engine.search(q, 5).collect()
    best = {r.query_id: r for r in rows if r.method == "hybrid" or r["rank"] <= 5}
    assert {r.name for r in rows if r.query_id == 1} >= {"AuthService"} and {r.name for r in rows if r.query_id == 2} >= {"Tokens"} and best
    assert all(r.score > 0 for r in rows) and all(sum(x.query_id == i for x in rows) <= 5 for i in (1, 2))
    assert {r.file_path for r in engine.search(q, 5, languages=["typescript"]).collect()} <= {"src/auth.ts", "src/hash.ts"}
    assert engine.search(q.limit(0)).count() == 0


def test_context_follows_imports(spark, engine):
    q = spark.createDataFrame([(1, "AuthService login")], "query_id int, text string")
    row = engine.context(q, k=1, kinds=["class"]).first()
    assert "AuthService" in row.content and "export function hash" in row.content and row.n_related >= 1 and not row.truncated
    assert engine.context(q, k=1, max_tokens=10, reserve=10).first().n_primary == 0


def test_reindex_replaces_and_removes(spark, engine):
    changed = {**FILES, "src/auth.ts": FILES["src/auth.ts"].replace("AuthService", "LoginService"), "new.py": "def fresh():\n    pass\n"}
    del changed["docs/guide.md"]
    got = {r.change: r.n for r in engine.index(frame(spark, changed)).collect()}
    assert got == {"added": 1, "deleted": 1, "modified": 1, "unchanged": 3}
    names = {r.name for r in engine.table("chunks").collect()}
    assert "LoginService" in names and "AuthService" not in names and "Tokens" not in names and "fresh" in names
    ids = {r.id for r in engine.table("chunks").collect()}
    assert ids == {r.id for r in engine.table("vectors").collect()} == {r.doc_id for r in engine.table("lexical/postings").collect()}
    assert [(r.source, r.target) for r in engine.table("edges").collect()] == [("src/auth.ts", "src/hash.ts")]
    again = {r.change: r.n for r in engine.index(frame(spark, changed)).collect()}
    assert again == {"unchanged": 5} and ids == {r.id for r in engine.table("chunks").collect()}
    assert engine.status().first().generation == 3


def test_providers(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, " ", "bad", "ccc"])], "i int, t string")

    def by_length(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    got = {r.i: (r.v, r.v_error) for r in providers.embed(rows.repartition(1), "t", by_length, batch=1).collect()}
    assert got == {0: ([1.0], None), 1: (None, None), 2: (None, None), 3: (None, "refused"), 4: ([3.0], None)}
    assert {r.i: r.summary for r in providers.summarize(rows, "t", lambda ts: [t.upper() for t in ts]).collect()}[4] == "CCC"
    assert len(providers.embed(rows, "t").where("i = 0").first().v) == 64
