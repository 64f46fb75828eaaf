"""Dependency graphs as two tables: nodes ``(id, file_path, symbols, type)``, edges ``(source, target, type)``.

Defined edge cases: edges with a null or empty end are left out of walks; self
edges never lead anywhere new; depth 0 reaches nothing; a start is not among what
it reaches; cycles end where nothing new is reached; repeated rows count once
unless multi-edges are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut

c = F.col


def ends(edges: DataFrame) -> DataFrame:
    """Both directions of every usable edge, once: ``a, b``."""
    fine = edges.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "") & (c("source") != c("target"))).select("source", "target")
    return fine.union(fine.select("target", "source")).toDF("a", "b").distinct()


def bfs(seeds: DataFrame, edges: DataFrame, depth: int = 2, seed: str = "seed") -> DataFrame:
    """``seed, node, distance`` of what is reached from each seed within ``depth`` steps, either way along edges.

    Each step is one join of the frontier; reached pairs leave by anti-join, so no
    path is walked twice. Lineage is cut from the third step on. Walks of hot nodes
    are split by adaptive skew joins.
    """
    both = ends(edges)
    frontier = seeds.select(c(seed).alias("seed"), c(seed).alias("node")).where("seed is not null").distinct()
    reached = frontier.withColumn("distance", F.lit(0))
    for step in range(1, depth + 1):
        new = frontier.join(both, frontier["node"] == both["a"]).select("seed", c("b").alias("node")).distinct()
        frontier = new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        reached = reached.unionByName(frontier.withColumn("distance", F.lit(step)))
        if step >= 2 and step < depth:
            frontier, reached = cut(frontier), cut(reached)
    return reached.where("distance > 0")


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^([^.]*)", 1)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def is_test(path: Column) -> Column:
    return path.rlike(r"\.(test|spec)\.")


def classify(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, node, relationship`` of pairs of ids, by the first that holds:

    backlog; test_for (a test file of the same base name, either way); an edge
    out (``interface_of`` for implements, else ``imports``); an edge in (``interface_of``
    for implements, else ``imported_by``); sibling (same directory); imports.
    """
    info = nodes.groupBy("id").agg(F.max("file_path").alias("path"), F.max(c("type") == "backlog").alias("backlog"))
    kinds = edges.where("source is not null and target is not null").groupBy("source", "target").agg(F.min("type").alias("kind"))
    rows = pairs.select("seed", "node").distinct()
    rows = rows.join(info.select(c("id").alias("seed"), c("path").alias("sp")), "seed", "left").join(info.select(c("id").alias("node"), c("path").alias("np"), c("backlog").alias("nb")), "node", "left")
    rows = rows.join(kinds.select(c("source").alias("seed"), c("target").alias("node"), c("kind").alias("out")), ["seed", "node"], "left")
    rows = rows.join(kinds.select(c("target").alias("seed"), c("source").alias("node"), c("kind").alias("back")), ["seed", "node"], "left")
    same_base = base_name(c("sp")) == base_name(c("np"))
    kind = (
        F.when(c("nb"), "backlog")
        .when(same_base & (is_test(c("sp")) != is_test(c("np"))), "test_for")
        .when(c("out") == "implements", "interface_of")
        .when(c("out").isNotNull(), "imports")
        .when(c("back") == "implements", "interface_of")
        .when(c("back").isNotNull(), "imported_by")
        .when((directory(c("sp")) == directory(c("np"))) & (directory(c("sp")) != ""), "sibling")
        .otherwise("imports")
    )
    return rows.select("seed", "node", kind.alias("relationship"))


def expand(results: DataFrame, nodes: DataFrame, edges: DataFrame, max_related: int = 10, depth: int = 2, *, min_distance: bool = False) -> DataFrame:
    """Related nodes of ranked results ``(query_id, node, rank)``: ``query_id, node, seed, distance, rank``.

    What a result itself is does not return. The first result that reaches a node
    keeps it, or with ``min_distance`` the nearest; at most ``max_related`` per query, nearest first.
    """
    reached = bfs(results.select(c("node").alias("seed")), edges, depth)
    found = results.select("query_id", c("node").alias("seed"), c("rank").alias("seed_rank")).join(reached, "seed").join(results.select("query_id", "node"), ["query_id", "node"], "left_anti")
    order = ["distance", "seed_rank"] if min_distance else ["seed_rank", "distance"]
    first = Window.partitionBy("query_id", "node").orderBy(*order, "seed")
    best = found.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    w = Window.partitionBy("query_id").orderBy("distance", "seed_rank", "node")
    return best.withColumn("rank", F.row_number().over(w)).where(c("rank") <= max_related).select("query_id", "node", "seed", "distance", "rank")


def excerpt(seeds: DataFrame, related: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between seeds and related nodes, and those that leave a related node for one of them."""
    known = seeds.select("node").union(related.select("node")).distinct()
    fine = edges.where("source <> '' and target <> ''").select("source", "target", "type").distinct()
    inside = fine.join(known.select(c("node").alias("source")), "source", "left_semi")
    return inside.join(known.select(c("node").alias("target")), "target", "left_semi").select("source", "target", "type")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.select(c("id").alias("source")), "source", "left_semi").join(ids.select(c("id").alias("target")), "target", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: incident edges, in and out; a self edge counts twice."""
    parts = F.explode(F.array("source", "target"))
    return edges.select(parts.alias("id")).where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.count("*").alias("degree"))


def connections(edges: DataFrame) -> DataFrame:
    """``id, direction, type, other, n``: incident edges of every node."""
    out = edges.select(c("source").alias("id"), F.lit("out").alias("direction"), "type", c("target").alias("other"))
    back = edges.select(c("target").alias("id"), F.lit("in").alias("direction"), "type", c("source").alias("other"))
    return out.unionByName(back).where("id <> '' and other <> ''").groupBy("id", "direction", "type", "other").agg(F.count("*").alias("n"))


def merge_nodes(nodes: DataFrame, order: list) -> DataFrame:
    """One node per id: the last written."""
    w = Window.partitionBy("id").orderBy(*order)
    return nodes.where("id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def prefix_graph(nodes: DataFrame, edges: DataFrame, sep: str = "::") -> tuple[DataFrame, DataFrame]:
    """Graph of many repositories: ids prefixed by the repository, and placeholder nodes for ends that have none."""
    name = lambda col: F.concat_ws(sep, "repo_name", col)
    n = nodes.where("id is not null").select(name("id").alias("id"), "type", "repo_name").distinct()
    e = edges.where("source <> '' and target <> ''").select(name("source").alias("source"), name("target").alias("target"), "type", "repo_name").distinct()
    known = n.select("id").distinct()
    missing = e.select(F.explode(F.array("source", "target")).alias("id"), "repo_name").distinct().join(known, "id", "left_anti")
    return n.unionByName(missing.select("id", F.lit("placeholder").alias("type"), "repo_name")), e


# ---- building from files -----------------------------------------------------------------

EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def normalize_path(path: Column) -> Column:
    """Path without ``.``, ``..`` and empty parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``file_path, source, target``: relative imports resolved against all files; the first candidate that exists wins.

    Candidates in order: as written, without ``.js``, with each extension (also in
    place of ``.js``), and as a folder's index.
    """
    relative = imports.where(c("source").startswith(".")).select("file_path", "source").distinct()
    base = normalize_path(F.concat(directory(c("file_path")), F.lit("/"), c("source")))
    bare = F.regexp_replace(base, r"\.js$", "")
    options = [base, bare, *(F.concat(bare, F.lit(e)) for e in EXTENSIONS), *(F.concat(base, F.lit("/index" + e)) for e in EXTENSIONS)]
    tried = relative.select("file_path", "source", F.posexplode(F.array(*options)).alias("pos", "target"))
    known = files.select(c("file_path").alias("target")).where("target is not null").distinct()
    found = tried.join(known, "target", "left_semi")
    return found.groupBy("file_path", "source").agg(F.min_by("target", "pos").alias("target"))


def test_map(tests: DataFrame, files: DataFrame) -> DataFrame:
    """``test_path, source_path``: tests whose path without ``.test`` or ``.spec`` is a file."""
    keyed = tests.select("test_path", F.regexp_replace("test_path", r"\.(test|spec)\.", ".").alias("source_path"))
    return keyed.join(files.select(c("file_path").alias("source_path")).distinct(), "source_path").select("test_path", "source_path")


def cross_repo(manifests: DataFrame) -> DataFrame:
    """``repo_name, target_repo, package, dev``: dependencies on packages of other repositories, by package or repository name.

    Of several repositories with one package name the last in the alphabet counts.
    """
    named = manifests.groupBy(F.coalesce("package_name", "repo_name").alias("package")).agg(F.max("repo_name").alias("target_repo"))
    named = named.union(manifests.where("package_name is not null").select("repo_name", "repo_name")).distinct()
    asked = manifests.select("repo_name", F.explode("dependencies").alias("package"), F.lit(False).alias("dev")).unionByName(manifests.select("repo_name", F.explode("dev_dependencies").alias("package"), F.lit(True).alias("dev")))
    return asked.distinct().join(named, "package").where("repo_name <> target_repo").select("repo_name", "target_repo", "package", "dev")
