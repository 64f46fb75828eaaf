"""All kinds of generated queries and their expected ids."""


def test_all_kinds_with_expected_ids(spark, tmp_path):
    from lodestrata.plans import catalog

    rows = [
        ("a", "load", "function", "Loads the settings of a run.", "r/x.ts"),
        ("b", "Kind", "type_alias", None, "r/y.ts"),
        ("t", "", "module", None, "r/x.test.ts"),
        ("s", None, "module", None, "r/y.spec.test.ts"),
        ("i", "head", "import_block", "An import block is not asked for.", "r/x.ts"),
    ]
    meta = "struct<chunk_type:string,name:string>"
    chunks = spark.createDataFrame([(i, (k, n), s, f) for i, n, k, s, f in rows], f"id string, metadata {meta}, nl_summary string, file_path string")
    edges = spark.createDataFrame([("r/x.ts", "r/y.ts", "imports"), ("q", "r/x.ts#load", "calls"), ("q", "r/x.ts#load", "extends"), ("b", "m", "imports")], "source string, target string, type string")
    chunks.write.parquet(str(tmp_path / "chunks.parquet"))
    edges.write.parquet(str(tmp_path / "graph_edges.parquet"))
    got = {tuple(r) for r in catalog.registry().fns["benchmark_queries"](spark, str(tmp_path)).collect()}
    assert got == {
        ("name", "load function", "a", "a"),
        ("name", "Kind type", "b", "b"),
        ("summary", "Loads the settings of a run.", "a", "a"),
        ("callers", "callers of load", "a", "q"),
        ("callers", "callers of load", "a", "a"),
        ("callers", "callers of Kind", "b", "r/x.ts"),
        ("callers", "callers of Kind", "b", "b"),
        ("imports", "imports of load", "a", "r/y.ts"),
        ("imports", "imports of load", "a", "a"),
        ("imports", "imports of Kind", "b", "m"),
        ("imports", "imports of Kind", "b", "b"),
        ("tests", "tests for load", "a", "t"),
        ("tests", "tests for load", "a", "a"),
    }
