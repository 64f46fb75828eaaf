"""An index of files in a folder of Parquet snapshots, and search, context and status over it.

Each run of ``index`` writes one generation of all tables and then marks it done;
readers take the last one that is done, so a run that is lost leaves nothing half
written in their way. Only changed files are chunked and embedded again; imports
resolve against all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import analytics, budget, chunking, fusion, graph, incremental, lexical, providers
from lodestrata.shipping import ship

c = F.col
FIELDS = {"content": "content", "summary": "nl_summary", "name": "name", "path": "file_path"}


class Engine:
    def __init__(self, spark: SparkSession, folder: str, provider: providers.EmbedFn | None = None):
        ship(spark)
        self.spark, self.folder, self.provider = spark, folder.rstrip("/"), provider

    # ---- storage

    def generation(self) -> int:
        """Number of the last complete generation, 0 without one."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[4:]) for n in names if n.startswith("gen=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/done"))]
        return max(done, default=0)

    def table(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/gen={generation or self.generation()}/{name}")

    # ---- indexing

    def _chunks(self, files: DataFrame, max_tokens: int) -> DataFrame:
        code = chunking.chunk_code(files)
        sized = chunking.split_oversize(code, max_tokens, keep=["file_path", "name", "chunk_type"])
        docs = chunking.chunk_markdown(files.where(F.lower("file_path").rlike(r"\.(md|mdx|markdown)$")), max_tokens=2 * max_tokens)
        columns = ["file_path", "name", "chunk_type", "start_line", "end_line", "content"]
        both = sized.select(*columns).unionByName(docs.select(*(F.lit("doc").alias(x) if x == "chunk_type" else c(x) for x in columns)))
        summary = F.nullif(F.trim(F.regexp_extract("content", r"^\s*([^\n.]+)", 1)), F.lit(""))
        return both.select(T.chunk_id(c("file_path"), c("start_line"), c("content")).alias("id"), *columns, T.detect_language(c("file_path")).alias("language"), summary.alias("nl_summary")).dropDuplicates(["id"])

    def index(self, files: DataFrame, max_tokens: int = 512) -> DataFrame:
        """Bring the index to ``files(file_path, content)``; returns ``change, n``."""
        old, new = self.generation(), self.generation() + 1
        at = f"{self.folder}/gen={new}"
        put = lambda rows, name: rows.write.mode("overwrite").parquet(f"{at}/{name}")
        files = files.select("file_path", "content").where("file_path is not null").groupBy("file_path").agg(F.max("content").alias("content"))  # of two contents the greater, always
        state = files.select("file_path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"))
        before = self.table("state", old) if old else state.limit(0)
        changes = incremental.detect_changes(state, before, "file_path", "content_hash")
        put(changes.join(state, "file_path", "left"), "changes")
        changes = self.table("changes", new)
        put(changes.where("change <> 'deleted'").select("file_path", "content_hash"), "state")
        dirty = files.join(changes.where("change in ('added', 'modified')").select("file_path"), "file_path", "left_semi")
        gone = changes.where("change <> 'unchanged'").select("file_path")

        put(self._chunks(dirty, max_tokens), "fresh")
        fresh = self.table("fresh", new)
        vectors = providers.embed(fresh.select("id", T.embed_text(c("nl_summary"), c("content")).alias("text")), "text", self.provider).select("id", "v")
        postings = lexical.build_postings(fresh, "id", FIELDS)
        imports = dirty.where(T.detect_language(c("file_path")).isin("javascript", "typescript", "tsx")).select("file_path", F.explode(T.js_imports(c("content"))).alias("i")).select("file_path", "i.source").distinct()
        if old:
            stale = self.table("chunks", old).join(gone, "file_path", "left_semi").select("id")
            kept = self.table("chunks", old).join(gone, "file_path", "left_anti")
            put(incremental.upsert(kept, fresh, "id"), "chunks")
            put(incremental.upsert(incremental.delete(self.table("vectors", old), stale, "id"), vectors, "id"), "vectors")
            lexical.write_index(lexical.update_postings(self.table("lexical/postings", old).drop("bucket"), stale.withColumnRenamed("id", "doc_id"), postings), f"{at}/lexical")
            put(self.table("imports", old).join(gone, "file_path", "left_anti").unionByName(imports), "imports")
        else:
            for rows, name in ((fresh, "chunks"), (vectors, "vectors"), (imports, "imports")):
                put(rows, name)
            lexical.write_index(postings, f"{at}/lexical")
        resolved = graph.resolve_imports(self.table("imports", new), self.table("state", new))
        put(resolved.select(c("file_path").alias("source"), "target", F.lit("imports").alias("type")).distinct(), "edges")
        put(self.spark.range(1), "done")
        return changes.groupBy("change").agg(F.count("*").alias("n"))

    # ---- queries

    def search(self, queries: DataFrame, k: int = 10, *, languages: list[str] | None = None, path: str | None = None, kinds: list[str] | None = None, vector_weight: float = 0.7, lexical_weight: float = 0.3) -> DataFrame:
        """Hybrid search of ``queries(query_id, text)``: ``query_id, rank, score, method`` and the chunk's columns.

        Filters apply before ranking.
        """
        now = self.generation()
        chunks, vectors, index = self.table("chunks", now), self.table("vectors", now), f"{self.folder}/gen={now}/lexical"
        if languages or path is not None or kinds:
            chunks = analytics.search_filter(chunks, languages=languages, path=path, kinds=kinds)
            vectors = vectors.join(chunks.select("id"), "id", "left_semi")
            postings = lexical.read_index(self.spark, index)[0].drop("bucket").join(chunks.select(c("id").alias("doc_id")), "doc_id", "left_semi")
            said = lexical.bm25(queries, postings, 2 * k)
        else:
            said = lexical.bm25_stored(queries, index, 2 * k)
        asked = providers.embed(queries.select("query_id", "text"), "text", self.provider).select("query_id", "v")
        near = fusion.vector_topk(asked, vectors.select(c("id").alias("doc_id"), "v"), 2 * k)
        fused = fusion.rrf(near, said, k, vector_weight=vector_weight, lexical_weight=lexical_weight)
        method = F.when(c("v_rank").isNull(), "bm25").when(c("b_rank").isNull(), "vector").otherwise("hybrid")
        return fused.select("query_id", c("doc_id").alias("id"), "rank", "score", method.alias("method")).join(chunks, "id")

    def context(self, queries: DataFrame, k: int = 10, max_related: int = 10, max_tokens: int = 8000, reserve: int = 2000, **filters) -> DataFrame:
        """One assembled context per query: results first, then chunks of files that the import graph relates to theirs."""
        now = self.generation()
        found = self.search(queries, k, **filters)
        files = found.groupBy("query_id", c("file_path").alias("node")).agg(F.min("rank").alias("rank"))
        edges = self.table("edges", now)
        related = graph.expand(files, None, edges, max_related)
        texts = related.select("query_id", c("node").alias("file_path"), "distance").join(self.table("chunks", now), "file_path")
        columns = ["query_id", "id", c("content").alias("text"), "name", "chunk_type", "file_path", "start_line", "end_line", c("nl_summary").alias("summary")]
        # files of one query are bounded by k and max_related
        nodes = files.select("query_id", "node").unionByName(related.select("query_id", "node")).distinct()
        ends = edges.join(nodes.withColumnRenamed("node", "source"), "source").join(nodes.select("query_id", c("node").alias("target")), ["query_id", "target"])
        links = ends.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("source", "target", "type"))).alias("edges"))
        excerpt = nodes.groupBy("query_id").agg(F.array_sort(F.collect_set("node")).alias("nodes")).join(links, "query_id", "left")
        excerpt = excerpt.withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<source:string,target:string,type:string>>")))
        return budget.assemble(found.select(*columns, "score"), texts.select(*columns, "distance"), excerpt, max_tokens=max_tokens, reserve=reserve)

    def explain(self, name: str | None = None, path: str | None = None, k: int = 20, *, detailed: bool = False) -> DataFrame:
        """Chunks by name or path, see ``analytics.explain``."""
        return analytics.explain(self.table("chunks"), name=name, path=path, k=k, detailed=detailed)

    def status(self) -> DataFrame:
        """One row: ``generation, chunks, files, vectors, edges``."""
        now = self.generation()
        one = lambda name: self.table(name, now).agg(F.count("*")).scalar()
        return self.spark.range(1).select(F.lit(now).alias("generation"), one("chunks").alias("chunks"), one("state").alias("files"), one("vectors").alias("vectors"), one("edges").alias("edges"))
