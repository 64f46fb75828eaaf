"""Graph queries over graph_nodes and graph_edges. Walks start from every work item whose number is divisible by 50 (the stated query set)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import graph as G
from lodestrata.plans.registry import Registry
from lodestrata.sources.tables import table

registry = Registry()
c = F.col

#: starts of the walks: backlog items whose number is divisible by 50
_SEEDS = r"seeds AS (SELECT DISTINCT id AS seed FROM graph_nodes WHERE type = 'backlog' AND TRY_CAST(regexp_extract(id, '(\d+)$', 1) AS INT) % 50 = 0)"
_BOTH = "fine AS (SELECT source, target FROM graph_edges WHERE source <> '' AND target <> '' AND source <> target), steps AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM fine UNION ALL SELECT target, source FROM fine))"
_WALK = f"""{_SEEDS}, {_BOTH},
 d1 AS (SELECT DISTINCT seed, b AS node FROM seeds JOIN steps ON a = seed WHERE b <> seed),
 d2 AS (SELECT DISTINCT seed, b AS node FROM d1 JOIN steps ON a = node WHERE b <> seed AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.seed = d1.seed AND x.node = b)),
 walk AS (SELECT seed, node, 1 AS distance FROM d1 UNION ALL SELECT seed, node, 2 FROM d2)"""


def _edges(spark, d):
    return table(spark, d, "graph_edges")


def _nodes(spark, d):
    return table(spark, d, "graph_nodes")


def _seeds(spark, d):
    number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    return _nodes(spark, d).where((c("type") == "backlog") & (number % 50 == 0)).select(c("id").alias("seed")).distinct()


@registry.query("graph_bfs", f"WITH {_WALK} SELECT seed, node, distance FROM walk")
def graph_bfs(spark, d):
    return G.bfs(_seeds(spark, d), _edges(spark, d), 2)


_REL = r"""info AS (SELECT id, max(file_path) AS path, max(CASE WHEN type = 'backlog' THEN 1 ELSE 0 END) AS backlog FROM graph_nodes GROUP BY 1),
 kinds AS (SELECT source, target, min(type) AS kind FROM graph_edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2),
 rel AS (SELECT w.seed, w.node, s.path AS sp, n.path AS np, n.backlog AS nb, o.kind AS okind, b.kind AS bkind FROM (SELECT DISTINCT seed, node FROM walk) w
  LEFT JOIN info s ON s.id = w.seed LEFT JOIN info n ON n.id = w.node LEFT JOIN kinds o ON o.source = w.seed AND o.target = w.node LEFT JOIN kinds b ON b.target = w.seed AND b.source = w.node)"""
_BASE = "regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '^([^.]*)', 1)"
_DIR = "CASE WHEN instr({0}, '/') > 0 THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
_TEST = r"regexp_matches({0}, '\.(test|spec)\.')"


@registry.query(
    "classify_relationship",
    f"""WITH {_WALK}, {_REL} SELECT seed, node, CASE WHEN nb = 1 THEN 'backlog' WHEN {_BASE.format("sp")} = {_BASE.format("np")} AND {_TEST.format("sp")} <> {_TEST.format("np")} THEN 'test_for'
    WHEN okind = 'implements' THEN 'interface_of' WHEN okind IS NOT NULL THEN 'imports' WHEN bkind = 'implements' THEN 'interface_of' WHEN bkind IS NOT NULL THEN 'imported_by'
    WHEN {_DIR.format("sp")} = {_DIR.format("np")} AND {_DIR.format("sp")} <> '' THEN 'sibling' ELSE 'imports' END AS relationship FROM rel""",
)
def classify_relationship(spark, d):
    return G.classify(G.bfs(_seeds(spark, d), _edges(spark, d), 2), _nodes(spark, d), _edges(spark, d))


_RESULTS = r"res AS (SELECT CAST(n // 250 AS INT) AS query_id, seed AS node, CAST(row_number() OVER (PARTITION BY n // 250 ORDER BY n, seed) AS INT) AS rank FROM (SELECT seed, CAST(regexp_extract(seed, '(\d+)$', 1) AS INT) AS n FROM seeds))"


def _results(spark, d):
    n = F.regexp_extract("seed", r"(\d+)$", 1).cast("int")
    from pyspark.sql import Window

    rows = _seeds(spark, d).select("seed", n.alias("n")).withColumn("query_id", F.floor(c("n") / 250).cast("int"))
    return rows.select("query_id", c("seed").alias("node"), F.row_number().over(Window.partitionBy("query_id").orderBy("n", "seed")).alias("rank"))


_FOUND = "found AS (SELECT r.query_id, w.node, w.seed, r.rank AS seed_rank, w.distance FROM res r JOIN walk w ON w.seed = r.node WHERE NOT EXISTS (SELECT 1 FROM res x WHERE x.query_id = r.query_id AND x.node = w.node))"


@registry.query(
    "expand_context",
    f"""WITH {_WALK}, {_RESULTS}, {_FOUND}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY seed_rank, distance, seed) AS rn FROM found) WHERE rn = 1)
    SELECT query_id, node, seed, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, seed_rank, node) AS INT) AS rank FROM best) WHERE rank <= 10""",
)
def expand_context(spark, d):
    return G.expand(_results(spark, d), _nodes(spark, d), _edges(spark, d))


@registry.query(
    "graph_excerpt",
    f"WITH {_WALK}, known AS (SELECT seed AS node FROM seeds UNION SELECT node FROM walk WHERE distance = 1) SELECT DISTINCT source, target, type FROM graph_edges WHERE source IN (SELECT node FROM known) AND target IN (SELECT node FROM known) AND source <> '' AND target <> ''",
)
def graph_excerpt(spark, d):
    seeds = _seeds(spark, d)
    return G.excerpt(seeds.select(c("seed").alias("node")), G.bfs(seeds, _edges(spark, d), 1), _edges(spark, d))


@registry.query("induced_edges", "SELECT edge_id, source, target, type FROM graph_edges WHERE source IN (SELECT id FROM graph_nodes WHERE type = 'module') AND target IN (SELECT id FROM graph_nodes WHERE type = 'module')")
def induced_edges(spark, d):
    return G.induced(_nodes(spark, d).where("type = 'module'"), _edges(spark, d)).select("edge_id", "source", "target", "type")


@registry.query("graph_filter", "SELECT edge_id FROM graph_edges WHERE source IN (SELECT id FROM graph_nodes WHERE contains(file_path, 'src/') AND type = 'module') AND target IN (SELECT id FROM graph_nodes WHERE contains(file_path, 'src/') AND type = 'module')")
def graph_filter(spark, d):
    return G.induced(_nodes(spark, d).where(c("file_path").contains("src/") & (c("type") == "module")), _edges(spark, d)).select("edge_id")


@registry.query("graph_view_filter", "SELECT type, count(*) AS n FROM graph_edges WHERE source IN (SELECT id FROM graph_nodes WHERE contains(lower(id), 'router')) AND target IN (SELECT id FROM graph_nodes WHERE contains(lower(id), 'router')) GROUP BY 1")
def graph_view_filter(spark, d):
    return G.induced(_nodes(spark, d).where(F.lower("id").contains("router")), _edges(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@registry.query("degree_centrality", "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM graph_edges UNION ALL SELECT target FROM graph_edges) WHERE id <> '' GROUP BY 1 ORDER BY degree DESC, id LIMIT 200")
def degree_centrality(spark, d):
    return G.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(200)


@registry.query("graph_neighbors", "SELECT id, count(DISTINCT CASE WHEN o THEN other END) AS dependencies, count(DISTINCT CASE WHEN NOT o THEN other END) AS dependents FROM (SELECT source AS id, target AS other, true AS o FROM graph_edges UNION ALL SELECT target, source, false FROM graph_edges) WHERE id <> '' AND other <> '' GROUP BY 1")
def graph_neighbors(spark, d):
    rows = G.connections(_edges(spark, d)).select("id", "direction", "other").distinct()
    return rows.groupBy("id").agg(F.count_if(c("direction") == "out").alias("dependencies"), F.count_if(c("direction") == "in").alias("dependents"))


@registry.query("graph_counts", "SELECT 'node' AS part, type, count(*) AS n FROM graph_nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM graph_edges GROUP BY 2")
def graph_counts(spark, d):
    of = lambda rows, part: rows.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "type", "n")
    return of(_nodes(spark, d), "node").unionByName(of(_edges(spark, d), "edge"))


@registry.query("node_connections", "SELECT id, direction, type, other, count(*) AS n FROM (SELECT source AS id, 'out' AS direction, type, target AS other FROM graph_edges UNION ALL SELECT target, 'in', type, source FROM graph_edges) WHERE id <> '' AND other <> '' GROUP BY ALL")
def node_connections(spark, d):
    return G.connections(_edges(spark, d))


@registry.query("dedup_edges", "SELECT DISTINCT source, target, type FROM graph_edges")
def dedup_edges(spark, d):
    return _edges(spark, d).select("source", "target", "type").distinct()


@registry.query("merge_graphs", "SELECT id, type, repo_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY first_seen_at DESC, repo_name, type) AS rn FROM graph_nodes WHERE id IS NOT NULL) WHERE rn = 1")
def merge_graphs(spark, d):
    return G.merge_nodes(_nodes(spark, d), [F.desc("first_seen_at"), "repo_name", "type"]).select("id", "type", "repo_name")


@registry.query(
    "merge_graphs_prefixed",
    """WITH n AS (SELECT DISTINCT repo_name || '::' || id AS id, type, repo_name FROM graph_nodes WHERE id IS NOT NULL), e AS (SELECT DISTINCT repo_name || '::' || source AS s, repo_name || '::' || target AS t, repo_name FROM graph_edges WHERE source <> '' AND target <> '')
    SELECT type, repo_name, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT DISTINCT id, 'placeholder', repo_name FROM (SELECT s AS id, repo_name FROM e UNION ALL SELECT t, repo_name FROM e) WHERE id NOT IN (SELECT id FROM n)) GROUP BY 1, 2""",
)
def merge_graphs_prefixed(spark, d):
    nodes, _ = G.prefix_graph(_nodes(spark, d), _edges(spark, d))
    return nodes.groupBy("type", "repo_name").agg(F.count("*").alias("n"))


_DEPS = "deps AS (SELECT DISTINCT repo_name, unnest(dependencies) AS package, false AS dev FROM manifests UNION SELECT DISTINCT repo_name, unnest(dev_dependencies), true FROM manifests), pk AS (SELECT coalesce(package_name, repo_name) AS package, max(repo_name) AS target_repo FROM manifests GROUP BY 1 UNION SELECT repo_name, repo_name FROM manifests WHERE package_name IS NOT NULL)"


@registry.query("cross_repo_deps", f"WITH {_DEPS} SELECT repo_name, target_repo, package, dev FROM deps JOIN pk USING (package) WHERE repo_name <> target_repo")
def cross_repo_deps(spark, d):
    return G.cross_repo(table(spark, d, "manifests"))


def _js(spark, d):
    return table(spark, d, "scanned_files").where(c("content").isNotNull() & F.lower("file_path").rlike(r"\.(ts|js|tsx|jsx|mjs|cjs)$")).select("file_path", "content").distinct()


#: imports of the tables name no files, so each file gets one import of every file of its folder's first letters: the next file by name
_IMPS = r"""f AS (SELECT DISTINCT file_path, regexp_replace(file_path, '/[^/]*$', '') AS dir, regexp_extract(file_path, '([^/]*)$', 1) AS base FROM scanned_files WHERE content IS NOT NULL AND regexp_matches(lower(file_path), '\.(ts|js|tsx|jsx|mjs|cjs)$')),
 nx AS (SELECT file_path, dir, lead(base) OVER (PARTITION BY dir ORDER BY base) AS nxt FROM f),
 imps AS (SELECT file_path, dir, './' || regexp_replace(nxt, '\.(ts|js)$', '') AS source, dir || '/' || regexp_replace(nxt, '\.(ts|js)$', '') AS stem FROM nx WHERE nxt IS NOT NULL),
 cand AS (SELECT file_path, source, stem || e AS target, p FROM imps, (VALUES ('', 0), ('.ts', 2), ('.tsx', 3), ('.js', 4), ('.jsx', 5), ('.mjs', 6), ('.cjs', 7)) v(e, p)),
 hit AS (SELECT file_path, source, arg_min(target, p) AS target FROM cand WHERE target IN (SELECT file_path FROM scanned_files) GROUP BY 1, 2)"""


def _resolved(spark, d):
    from pyspark.sql import Window

    names = _js(spark, d).select("file_path", G.directory(c("file_path")).alias("dir"), F.regexp_extract("file_path", r"([^/]*)$", 1).alias("base")).distinct()
    following = names.withColumn("nxt", F.lead("base").over(Window.partitionBy("dir").orderBy("base"))).where("nxt is not null")
    imports = following.select("file_path", F.concat(F.lit("./"), F.regexp_replace("nxt", r"\.(ts|js)$", "")).alias("source"))
    # what the files themselves import is resolved too
    own = _js(spark, d).select("file_path", F.explode(T.js_imports(c("content"))).alias("i")).select("file_path", "i.source")
    return G.resolve_imports(imports.unionByName(own), table(spark, d, "scanned_files"))


@registry.query("resolve_imports", f"WITH {_IMPS} SELECT * FROM hit")
def resolve_imports(spark, d):
    return _resolved(spark, d)


@registry.query("build_graph", f"WITH {_IMPS} SELECT 'node' AS part, file_path AS source, file_path AS target FROM f UNION ALL SELECT DISTINCT 'edge', file_path, target FROM hit")
def build_graph(spark, d):
    nodes = _js(spark, d).select(F.lit("node").alias("part"), c("file_path").alias("source"), c("file_path").alias("target")).distinct()
    return nodes.unionByName(_resolved(spark, d).select(F.lit("edge").alias("part"), c("file_path").alias("source"), "target").distinct())


@registry.query(
    "test_map",
    r"""WITH p AS (SELECT DISTINCT file_path FROM scanned_files WHERE regexp_matches(file_path, '\.(ts|js|py)$')), t AS (SELECT regexp_replace(file_path, '\.(\w+)$', '.test.\1') AS test_path FROM p UNION ALL SELECT regexp_replace(file_path, '\.(\w+)$', '.spec.\1') FROM p WHERE contains(file_path, 'src/'))
    SELECT test_path, file_path AS source_path FROM t JOIN p ON p.file_path = regexp_replace(test_path, '\.(test|spec)\.', '.')""",
)
def test_map(spark, d):
    """Test files and their sources; the tables hold no tests, so every source gets one, and two under ``src/``."""
    paths = table(spark, d, "scanned_files").where(c("file_path").rlike(r"\.(ts|js|py)$")).select("file_path").distinct()
    named = lambda rows, mark: rows.select(F.regexp_replace("file_path", r"\.(\w+)$", f".{mark}.$1").alias("test_path"))
    tests = named(paths, "test").unionByName(named(paths.where(c("file_path").contains("src/")), "spec"))
    return G.test_map(tests, paths)
