"""Field-boosted BM25 over postings.

Postings are ``(doc_id, field, term, tf, dl)``. Queries join them on the term,
so only postings of asked terms move; a query is never crossed with documents.
Only the k best of each query in each run of documents move on (``operators/product.py``);
texts that are asked once (``bm25_texts``, ``overlap_texts``) are read where they lie, and no posting of theirs is written.
Scores are our own definition (Robertson and Zaragoza), summed over fields with
boosts, and rounded to 6 decimals so that ranks have one order everywhere.

A stored index (``write_index``) is a Parquet folder partitioned by a hash of the term, sorted by
term, with document frequencies and field statistics counted once, when it is
written. A search reads the buckets of the asked terms only, and scans no
posting to count.

Defined edge cases: null and blank fields have no postings; repeated query terms
count once; queries without terms have no results; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import product
from lodestrata.operators.skew import salted
from lodestrata.session import cut

K1, B = 1.2, 0.75
#: fixed values: weights of the fields
BOOSTS = {"content": 1.0, "summary": 2.0, "name": 1.5, "path": 0.5}
BROADCAST_TERMS = 200_000
BUCKETS, WRITERS = 64, 8
PREFIX_WEIGHT, FUZZY_WEIGHT = 0.375, 0.45
#: documents, and pairs of queries and documents, that a rare term may have (a number or a share of all documents, the larger holds)
RARE, RARE_SHARE = 1000, 0.001
#: pairs of queries and documents from which expanded queries are grouped
GROUPED_FROM = 4_000_000_000
#: documents from which texts are scored in waves, and the ends of the waves as shares of all
WAVES_FROM, WAVES = 1_000_000, (1, 4, 12)


def build_postings(docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Postings of the columns ``fields`` (field name -> column).

    Documents are spread by id before their terms are listed, which moves each text
    once and lets terms, and later scores, be summed without another shuffle.
    """
    # by number, as texts grow when listed and adaptive coalescing only sees their size before
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(id_col, *dict.fromkeys(fields.values())).repartition(parts, id_col)
    listed = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), T.terms(F.col(c)).alias("terms")) for f, c in fields.items())))
    rows = docs.select(F.col(id_col).alias("doc_id"), listed.alias("p")).select("doc_id", "p.field", F.size("p.terms").alias("dl"), F.explode("p.terms").alias("term"))
    return rows.groupBy("doc_id", "field", "term", "dl").agg(F.count("*").alias("tf"))


def field_stats(postings: DataFrame) -> DataFrame:
    """``field, n_docs, avg_dl``: one row per field."""
    return postings.select("doc_id", "field", "dl").distinct().groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(postings: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Write ``postings``, ``terms`` (field, term, df) and ``stats`` (field, n_docs, avg_dl, buckets) below ``folder``."""
    rows = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    # a common term may hold a large share of all postings: its bucket is written by several tasks
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(WRITERS))).sortWithinPartitions("bucket", "term", "field", "doc_id")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    stored = postings.sparkSession.read.schema(rows.schema).parquet(f"{folder}/postings")
    counts = stored.groupBy("bucket", "field", "term").agg(F.count("*").alias("df"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    field_stats(stored).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/stats")


_STORED = "doc_id {0}, field string, term string, dl int, tf bigint, bucket int"


def read_index(spark: SparkSession, folder: str, id_type: str = "string") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``postings, terms, stats`` of a stored index."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return read("postings", _STORED.format(id_type)), read("terms", "field string, term string, df bigint, bucket int"), read("stats", "field string, n_docs bigint, avg_dl double, buckets int")


def bm25_stored(queries: DataFrame, folder: str, k: int = 10, *, id_col: str = "query_id", text_col: str = "text", id_type: str = "string", boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """``query_id, doc_id, score, rank`` by a stored index; only the buckets of asked terms are read."""
    postings, terms, stats = read_index(queries.sparkSession, folder, id_type)
    first = stats.select("buckets").first()
    asked = query_terms(queries, id_col, text_col)
    if first is None:
        return top(score(asked, postings, boosts), k)
    # at most one row per bucket comes to the driver, and their number is fixed when the index is written
    wanted = sorted(r.bucket for r in asked.select(bucket_of(F.col("term"), first.buckets).alias("bucket")).distinct().collect())
    here = F.col("bucket").isin(wanted) if wanted else F.lit(False)
    return _of_postings(asked, asked, postings.where(here), terms.where(here).select("field", "term", "df"), stats.drop("buckets"), k, boosts)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, term, weight`` of the distinct terms of each query."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(T.terms(F.col(text_col)))).alias("term"), F.lit(1.0).alias("weight"))


def expand_prefix(asked: DataFrame, postings: DataFrame, weight: float = PREFIX_WEIGHT, least: int = 3) -> DataFrame:
    """Query terms and the vocabulary's terms that begin with them (terms of at least ``least`` letters).

    The prefixes of the vocabulary are exploded, so this is an equi-join.
    """
    vocabulary = postings.select("term").distinct()
    prefixes = vocabulary.select("term", F.explode(F.sequence(F.lit(least), F.greatest(F.lit(least), F.length("term") - 1))).alias("n")).where(F.col("n") < F.length("term")).select(F.expr("substring(term, 1, n)").alias("head"), F.col("term").alias("found"))
    more = asked.join(prefixes, F.col("term") == F.col("head")).select("query_id", F.col("found").alias("term"), (F.col("weight") * weight).alias("weight"))
    return asked.unionByName(more).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def expand_fuzzy(asked: DataFrame, postings: DataFrame, weight: float = FUZZY_WEIGHT, share: float = 0.2) -> DataFrame:
    """Query terms and the vocabulary's terms within ``d = round(share * length)`` edits (so terms of 3 letters and more); ``share`` at most a half.

    For d of 1 and 2 terms meet by joining on deletions: every term is listed under all
    results of deleting up to two letters. For more, the query term is cut into d + 1
    consecutive pieces, one of which d edits must leave whole and shift by d at most: an
    equi-join with the vocabulary's substrings of the pieces' lengths. Matches of both are
    checked exactly.
    """
    if not 0 < share <= 0.5:
        raise ValueError("share must be above 0 and at most 0.5")
    d = lambda c: F.round(F.length(c) * share).cast("int")
    # the shortest terms that allow 2 and 3 edits
    two_from, three_from = (math.ceil(x / share) for x in (1.5, 2.5))
    vocabulary = postings.select(F.col("term").alias("found")).distinct().where(F.length("found") >= 2)
    terms = asked.select("term").distinct()

    def deletions(col: str):
        c = F.col(col)
        once = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))
        one = once(c)
        # two deletions only where two edits may be allowed (a neighbour may be two letters shorter or longer)
        two = F.when(F.length(c) >= two_from - 2, F.flatten(F.transform(one, once))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(c), one, two))

    left = terms.where((d("term") >= 1) & (d("term") <= 2)).withColumn("key", F.explode(deletions("term")))
    right = vocabulary.where(F.length("found") < three_from + 2).withColumn("key", F.explode(deletions("found")))
    near = left.join(right, "key").select("term", "found").distinct()

    # piece i of d + 1 begins after floor(i * length / (d + 1)) letters
    start = lambda i: F.floor(i * F.length("term") / (d("term") + 1)).cast("int")
    piece = lambda i: F.struct((start(i) + 1).alias("at"), F.substr("term", start(i) + 1, start(i + 1) - start(i)).alias("key"))
    # d edits leave at least length - d letters, and the pieces' lengths lie between these for every length
    least = next(n for n in range(three_from, 2 * three_from) if math.floor(n * share + 0.5) >= 3)
    shortest, longest = max(1, int(least / (least * share + 1.5))), math.ceil(1 / share)
    grams = lambda n: F.when(F.length("found") >= n, F.transform(F.sequence(F.lit(1), F.length("found") - n + 1), lambda i: F.struct(i.alias("stands"), F.substr("found", i, F.lit(n)).alias("key")))).otherwise(F.array().cast("array<struct<stands:int,key:string>>"))
    pieces = terms.where(d("term") >= 3).select("term", F.inline(F.transform(F.sequence(F.lit(0), d("term")), piece)))
    parts = vocabulary.where(F.length("found") >= three_from - math.floor(three_from * share + 0.5)).select("found", F.inline(F.concat(*(grams(n) for n in range(shortest, longest + 1)))))
    within = (F.abs(F.col("at") - F.col("stands")) <= d("term")) & (F.abs(F.length("term") - F.length("found")) <= d("term"))
    far = pieces.join(parts, "key").where(within).select("term", "found").distinct()

    # levenshtein with a limit takes a number, not a column
    close = near.unionByName(far).where((F.col("term") != F.col("found")) & (F.levenshtein("term", "found") <= d("term")))
    more = asked.join(close, "term").select("query_id", F.col("found").alias("term"), (F.col("weight") * weight).alias("weight"))
    return asked.unionByName(more).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def score(asked: DataFrame, postings: DataFrame, boosts: dict[str, float] = BOOSTS, df: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score`` of every document that has an asked term; ``df`` and ``stats`` are counted where they are not given.

    Up to ``BROADCAST_TERMS`` asked terms (they are counted) go to the postings, which
    then stay where they are; more terms meet the postings by a shuffle on the term.
    """
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    df = postings.groupBy("field", "term").agg(F.count("*").alias("df")) if df is None else df
    # the statistics have one row per field: their size is the number of boosts
    stats = field_stats(postings) if stats is None else stats
    boost = F.create_map(*(F.lit(x) for k, v in boosts.items() for x in (k, v)))
    hits = asked.join(df, "term").join(F.broadcast(stats), "field")
    weighted = hits.select("query_id", "field", "term", (F.col("weight") * F.coalesce(F.try_element_at(boost, F.col("field")), F.lit(1.0)) * F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"), "avg_dl")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    if few:
        found = postings.join(F.broadcast(weighted), ["field", "term"])
    else:  # a common term's postings may be a third of all
        left, right = salted(postings, weighted, ["field", "term"], "doc_id")
        found = left.join(right.hint("shuffle_merge"), ["field", "term", "salt"])
    found = found.select("query_id", "doc_id", (F.col("w") * tf).alias("s"))
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def overlap(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``: occurrences of a query's terms in a document over the number of its terms."""
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    sized = asked.join(sizes, "query_id").select("query_id", "term", "n")
    if few:
        found = postings.join(F.broadcast(sized), "term")
    else:
        left, right = salted(postings, sized, "term", "doc_id")
        found = left.join(right.hint("shuffle_merge"), ["term", "salt"])
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum("tf") / F.max("n"), 6).alias("score"))


def top(scored: DataFrame, k: int, score_col: str = "score", id_col: str = "doc_id") -> DataFrame:
    """The ``k`` best documents of each query with their ``rank`` from 1; ``k`` below 1: none."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score_col), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, k))


def _expanded(exact: DataFrame, vocabulary: DataFrame, prefix: bool, fuzzy: bool) -> DataFrame:
    """``query_id, term, weight`` of the asked terms and of those that they are expanded to."""
    asked = expand_prefix(exact, vocabulary) if prefix else exact
    if fuzzy:
        asked = asked.unionByName(expand_fuzzy(exact, vocabulary)).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    return asked


def _few(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def _sources(terms: DataFrame, df: DataFrame, prefix: bool, fuzzy: bool) -> DataFrame:
    """Each distinct asked term expanded once, as a query of its own."""
    return cut(_expanded(terms.select(F.col("term").alias("query_id"), "term", F.lit(1.0).alias("weight")), df.select("term").distinct(), prefix, fuzzy))


class _Weights:
    """What a product needs of the asked terms: their places, their weights by field, their expansions. ``few``: they fit ``BROADCAST_TERMS``."""

    def __init__(self, exact: DataFrame, df: DataFrame, stats: DataFrame, boosts: dict[str, float], prefix: bool = False, fuzzy: bool = False):
        terms, self.rows = exact.select("term").distinct(), None
        self.stats = {r.field: r for r in stats.collect()}  # one row per field
        self.fields = list(self.stats)
        self.boosts = [float(boosts.get(f, 1.0)) for f in self.fields]
        self.usable = bool(self.fields) and min(self.boosts) > 0
        self.few = self.usable and _few(terms)
        if self.few and (prefix or fuzzy):
            self.rows = _sources(terms, df, prefix, fuzzy)
            terms = self.rows.select("term").distinct()
            self.few = _few(terms)
        if self.few:
            self.read(df, terms, self.rows)

    def read(self, df: DataFrame, terms: DataFrame, more: DataFrame | None) -> None:
        found = df.join(terms, "term", "left_semi").select("field", "term", "df").toArrow()
        self.terms, at = product.numbered(product.flat(found["term"]))
        field = product.codes(product.flat(found["field"]), pa.array(self.fields, pa.string()))
        n_docs, self.avg_dl, boost = np.array([r.n_docs for r in self.stats.values()]), np.array([r.avg_dl for r in self.stats.values()]), np.array(self.boosts)
        self.known, df_of = field >= 0, found["df"].to_numpy()
        self.idf, self.common = np.zeros((len(self.fields), len(self.terms))), np.zeros(len(self.terms))
        ok = self.known
        self.idf[field[ok], at[ok]] = boost[field[ok]] * np.log1p((n_docs[field[ok]] - df_of[ok] + 0.5) / (df_of[ok] + 0.5))
        np.add.at(self.common, at[ok], df_of[ok] / n_docs.max())
        self.more = None
        if more is not None:
            rows = more.toArrow()
            sources, s = product.numbered(product.flat(rows["query_id"]))
            t, w = product.codes(product.flat(rows["term"]), self.terms), rows["weight"].to_numpy()
            order = np.argsort(s, kind="stable")
            order = order[t[order] >= 0]
            self.more = sources, np.searchsorted(s[order], np.arange(len(sources) + 1)), t[order], w[order]

    def value(self):
        idf, avg_dl = self.idf, self.avg_dl
        return lambda i, t, tf, dl: idf[i, t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl[i]))


def _of_postings(exact: DataFrame, asked: DataFrame, postings: DataFrame, df: DataFrame, stats: DataFrame, k: int, boosts: dict[str, float] = BOOSTS, prefix: bool = False, fuzzy: bool = False) -> DataFrame:
    """The best by postings: those of asked terms are brought together by document."""
    weights = _Weights(exact, df, stats, boosts, prefix, fuzzy) if k > 0 else None
    if weights is None or not weights.few:
        return top(score(asked, postings, boosts, df, stats), k)
    spark, (n_fields, n_terms) = postings.sparkSession, weights.idf.shape
    sent = product.blocks(exact, weights.terms, weights.common, weights.more)
    field, term = (x.ravel() for x in np.indices((n_fields, n_terms)))
    has = weights.idf.ravel() > 0
    places = pa.table({"field": pa.array(weights.fields, pa.string()).take(pa.array(field[has])), "term": weights.terms.take(pa.array(term[has])), "code": pa.array(term[has], pa.int32()), "idf": weights.idf.ravel()[has], "avg_dl": weights.avg_dl[field[has]]})
    known = F.broadcast(spark.createDataFrame(places))
    v = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    entries = postings.join(known, ["field", "term"]).select("doc_id", "code", v.alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_doc = entries.repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    return top(product.top(by_doc, product.of_entries, sent, "doc_id", dict(exact.dtypes)["query_id"], k), k)


def bm25(queries: DataFrame, postings: DataFrame, k: int = 10, *, id_col: str = "query_id", text_col: str = "text", prefix: bool = False, fuzzy: bool = False) -> DataFrame:
    """``query_id, doc_id, score, rank``."""
    exact = query_terms(queries, id_col, text_col)
    df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))
    return _of_postings(exact, _expanded(exact, postings, prefix, fuzzy), postings, df, field_stats(postings), k, BOOSTS, prefix, fuzzy)


def _listed(docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), *(T.terms(F.col(c)).alias(f) for f, c in fields.items()))


def count_terms(docs: DataFrame, id_col: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``field, term, df`` and ``field, n_docs, avg_dl`` of documents with distinct ids; texts stay where they are."""
    # the empty term stands for the field itself
    of = lambda f: F.struct(F.lit(f).alias("field"), F.size(f).alias("dl"), F.when(F.size(f) > 0, F.concat(F.array(F.lit("")), F.array_distinct(f))).otherwise(F.array().cast("array<string>")).alias("terms"))
    rows = _listed(docs, id_col, fields).select(F.explode(F.array(*map(of, fields))).alias("p")).select("p.field", "p.dl", F.explode("p.terms").alias("term"))
    counted = cut(rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("dls")))
    return counted.where("term <> ''").select("field", "term", "df"), counted.where("term = ''").select("field", F.col("df").alias("n_docs"), (F.col("dls") / F.col("df")).alias("avg_dl"))


def _repeated(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0


def _asked_once(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_terms`` that are listed once, however often they are read."""
    lists = cut(queries.select(F.col(id_col).alias("query_id"), F.array_distinct(T.terms(F.col(text_col))).alias("terms")))
    return lists.select("query_id", F.explode("terms").alias("term"), F.lit(1.0).alias("weight"))


def bm25_texts(queries: DataFrame, docs: DataFrame, doc_id: str, fields: dict[str, str], k: int = 10, *, id_col: str = "query_id", text_col: str = "text", prefix: bool = False, fuzzy: bool = False) -> DataFrame:
    """``bm25`` over documents that have no index: they are read twice, to count and to score, and never moved.

    Documents whose id stands more than once are brought together first.
    """
    if k < 1 or _repeated(docs, doc_id):
        return bm25(queries, cut(build_postings(docs, doc_id, fields)), k, id_col=id_col, text_col=text_col, prefix=prefix, fuzzy=fuzzy)
    exact = _asked_once(queries, id_col, text_col)
    df, stats = count_terms(docs, doc_id, fields)
    weights = _Weights(exact, df, stats, BOOSTS, prefix, fuzzy)
    found = _in_parts(exact, docs, doc_id, fields, df, weights, k, prefix, fuzzy) if weights.usable and (prefix or fuzzy or not weights.few) else None
    if found is not None:
        return found
    if not weights.few:
        return top(score(_expanded(exact, df, prefix, fuzzy), build_postings(docs, doc_id, fields), df=df, stats=stats), k)
    sent = product.blocks(exact, weights.terms, weights.common, weights.more)
    rows = _listed(docs, doc_id, {f: fields[f] for f in weights.fields})
    return _in_waves(rows, product.of_texts(weights.terms, weights.fields, weights.value()), sent, dict(exact.dtypes)["query_id"], k, max(r.n_docs for r in weights.stats.values()))


def _in_parts(exact: DataFrame, docs: DataFrame, doc_id: str, fields: dict[str, str], df: DataFrame, weights: _Weights, k: int, prefix: bool, fuzzy: bool) -> DataFrame | None:
    """The best where more terms are asked than fit ``BROADCAST_TERMS``, or many queries are alike; None: the shared terms do not fit either, or few are alike.

    An asked term's expansions are shared if many documents have them, or if they make many pairs of queries and documents; the others are rare.
    Queries with equal shared parts are one group, of which the ``k`` best documents are found by block products.
    Documents that have a query's rare terms meet it by joins, and their scores are added to those of its group.
    Weights and values are above 0, so any other document stands behind the group's best.
    """
    kind, n_docs = dict(exact.dtypes)["query_id"], max(r.n_docs for r in weights.stats.values())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_queries = exact.select("query_id").distinct().count()
    if weights.few and n_queries * n_docs < GROUPED_FROM:
        return None
    terms = exact.select("term").distinct()
    more = weights.rows
    if more is None:
        more = _sources(terms, df, prefix, fuzzy) if prefix or fuzzy else terms.select(F.col("term").alias("query_id"), "term", F.lit(1.0).alias("weight"))
    sizes = df.groupBy("term").agg(F.sum("df").alias("df"))
    asked = exact.groupBy(F.col("term").alias("source")).agg(F.count("*").alias("asked"))
    limit = max(RARE, RARE_SHARE * n_docs)
    pairs = F.col("asked") * F.sum(F.when(F.col("df") <= limit, F.col("df"))).over(Window.partitionBy("source"))
    shared = (F.col("df") > limit) | (pairs > limit)
    rows = more.select(F.col("query_id").alias("source"), "term", "weight").join(sizes, "term").join(asked, "source")
    rows = cut(rows.select("source", "term", "weight", shared.alias("shared")))
    common = rows.where("shared").select(F.col("source").alias("query_id"), "term", "weight")
    if not _few(common.select("term").distinct()):
        return None

    # a group goes by the smallest id of its queries
    marks = common.select(F.col("query_id").alias("term"), F.lit(True).alias("shared")).distinct()
    marked = exact.join(marks, "term", "left")
    keys = marked.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("shared"), F.col("term")))).alias("key"))
    members = cut(keys.join(keys.groupBy("key").agg(F.min("query_id").alias("group")), "key").select("query_id", "group"))
    first = members.where(F.col("query_id").eqNullSafe(F.col("group"))).select("group")
    if weights.few and 2 * first.count() > n_queries:
        return None
    weights.read(df, common.select("term").distinct(), common)
    of_groups = cut(marked.where("shared").join(first, F.col("query_id").eqNullSafe(F.col("group")), "left_semi").select("query_id", "term", "weight"))
    sent = product.blocks(of_groups, weights.terms, weights.common, weights.more)
    # a term in more than ``limit`` documents is not rare, and at most all tokens over ``limit`` are such
    often = product.flat(sizes.where(F.col("df") > limit).select("term").toArrow()["term"])
    listed = _listed(docs, doc_id, {f: fields[f] for f in weights.fields})
    split = cut(product.entries(listed, weights.terms, weights.fields, weights.value(), often))
    entries = split.select("doc_id", "codes", "vals")
    best = cut(_in_waves(entries, product.of_lists, sent, kind, k, n_docs).withColumnRenamed("query_id", "group"))
    least = product.floors(best.where(F.col("rank") == k).withColumnRenamed("group", "query_id"), sent)

    # what a query asks beyond its group
    grouped = exact.join(members.withColumnRenamed("query_id", "member"), F.col("query_id").eqNullSafe(F.col("member"))).select("query_id", "group", F.col("term").alias("source"), F.col("weight").alias("by"))
    own = grouped.join(rows.where("not shared"), "source").select("query_id", "group", "term", (F.col("by") * F.col("weight")).alias("weight"))
    own = product.less(own, weights.terms, sent).repartition(parts, "term").groupBy("query_id", "group", "term").agg(F.max("weight").alias("weight"))
    lists = split.select("doc_id", F.inline("rare")).repartition(parts, "term").groupBy("term", "field").agg(F.collect_list(F.struct("doc_id", "dl", "tf")).alias("docs"))
    of_field = lambda xs: F.try_element_at(F.create_map(*(F.lit(x) for f, v in zip(weights.fields, xs, strict=True) for x in (f, float(v)))), F.col("field"))
    n, in_docs = of_field(r.n_docs for r in weights.stats.values()), F.size("docs")
    weight = F.col("weight") * of_field(weights.boosts) * F.log1p((n - in_docs + 0.5) / (in_docs + 0.5))
    found = lists.join(own, "term").select("query_id", "group", weight.alias("w"), of_field(r.avg_dl for r in weights.stats.values()).alias("avg_dl"), F.inline("docs"))
    s = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    hits = found.select("doc_id", F.struct("query_id", "group", s.alias("s")).alias("hit"))
    both = entries.unionByName(hits, allowMissingColumns=True)
    by_doc = both.groupBy("doc_id").agg(F.first("codes", ignorenulls=True).alias("codes"), F.first("vals", ignorenulls=True).alias("vals"), F.collect_list("hit").alias("hits")).where(F.size("hits") > 0)
    of_group = members.join(best, members["group"].eqNullSafe(best["group"])).select("query_id", "doc_id", "score")
    return top(of_group.unionByName(product.added(by_doc, sent, kind, least)).groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def _in_waves(rows: DataFrame, read: product.Documents, sent: list, query_kind: str, k: int, n_docs: int) -> DataFrame:
    """The ``k`` best of each query over all ``rows``, whose ids are distinct.

    A run of documents sends up to ``k`` rows of each query. Of many documents a share is scored first, in few runs;
    of the others only those move that reach the ``k``-th score so far. Each document is scored in one wave.
    """
    best, ends = None, WAVES if n_docs >= WAVES_FROM else WAVES[-1:]
    for lo, hi in zip((0, *ends), ends):
        part, least = rows, None
        if len(ends) > 1:
            share = F.pmod(F.xxhash64("doc_id"), F.lit(WAVES[-1]))
            part = rows.where((share >= lo) & (share < hi))
        if best is None and len(ends) > 1:
            part = part.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        elif best is not None:
            least = product.floors(best.where(F.col("rank") == k), sent)
        found = product.top(part, read, sent, "doc_id", query_kind, k, least=least)
        best = top(found if best is None else found.unionByName(best.drop("rank")), k)
        if hi < ends[-1]:
            best = cut(best)
    return best


def overlap_texts(queries: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int = 10, *, id_col: str = "query_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """The ``k`` best by ``overlap`` of terms of at least ``least`` letters, over documents that have no index."""
    exact = _asked_once(queries, id_col, text_col).where(F.length("term") >= least)
    if k > 0 and not _repeated(docs, doc_id):
        df, stats = count_terms(docs, doc_id, {"content": text})
        weights = _Weights(exact, df, stats, {})
        if weights.few:
            sent = product.blocks(exact, weights.terms, weights.common, sized=True)
            rows = _listed(docs, doc_id, {"content": text})
            found = product.top(rows, product.of_texts(weights.terms, ["content"], lambda i, t, tf, dl: tf.astype("float64")), sent, "doc_id", dict(exact.dtypes)["query_id"], k, digits=None)
            return top(found.withColumn("score", F.round("score", 6)), k)
    return top(overlap(exact, build_postings(docs, doc_id, {"content": text})), k)


def update_postings(postings: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Postings without the documents of ``removed`` (``doc_id``) and of ``added``, plus ``added``."""
    gone = removed.select("doc_id").union(added.select("doc_id")).distinct()
    return postings.join(gone, "doc_id", "left_anti").unionByName(added)
