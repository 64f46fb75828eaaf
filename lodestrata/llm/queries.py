"""Queries of the training-data problems, with their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.llm import bpe, language, leakage, neighbours, provenance, secrets, split
from lodestrata.plans.registry import Registry
from lodestrata.sources.tables import table

registry = Registry()


# the rule by recursion: n is the next new line, r how many lines before it may be repeated, o how much of a long line is done; c are sums of lengths
_P2 = r"""WITH RECURSIVE lim AS (SELECT chunk_type, any_value(max_chars) AS m, any_value(overlap_lines) AS v FROM split_limits WHERE chunk_type IS NOT NULL GROUP BY 1),
 ch AS (SELECT DISTINCT id, content, coalesce(start_line, 1) AS f, coalesce(a.m, b.m) AS m, greatest(0, coalesce(a.v, b.v, 0)) AS v FROM chunks LEFT JOIN lim a ON a.chunk_type = metadata.chunk_type LEFT JOIN lim b ON b.chunk_type = 'default' WHERE content IS NOT NULL),
 li AS (SELECT row_number() OVER () AS k, *, string_split(content, chr(10)) AS l FROM ch WHERE m > 0 AND length(content) > m),
 it AS (SELECT k, id, f, m, v, l, CAST(len(l) AS INT) AS t, list_transform(l, lambda x: length(x)) AS w, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(list_transform(l[1:i], lambda x: length(x))), 0)) AS c, list_transform(l, lambda x: regexp_full_match(x, '\s*[\]}\);,]*\s*')) AS g FROM li),
 st(k, no, a, b, n, r, o, x) AS (
  SELECT k, 0, 0, 0, 1, 0, 0, '' FROM it
  UNION ALL
  SELECT k, no + 1, CASE WHEN w[n] > m THEN n ELSE s END, CASE WHEN w[n] > m THEN n ELSE e END,
   CASE WHEN w[n] > m AND o + m < w[n] THEN n WHEN w[n] > m THEN n + 1 ELSE e + 1 END, CASE WHEN w[n] > m THEN 0 ELSE least(v, e - s + 1) END, CASE WHEN w[n] > m AND o + m < w[n] THEN o + m ELSE 0 END,
   CASE WHEN w[n] > m THEN l[n][o + 1:o + m] ELSE array_to_string(l[s:e], chr(10)) END
  FROM (SELECT *, CASE WHEN u = t THEN u ELSE coalesce(list_max(list_filter(range(n, u + 1), lambda i: g[i])), u) END AS e
   FROM (SELECT *, coalesce(list_max(list_filter(range(n, t + 1), lambda i: c[i + 1] - c[s] + i - s <= m)), n) AS u
    FROM (SELECT st.*, m, v, t, l, w, c, g, CASE WHEN c[n + 1] - c[n - r] + r > m THEN n ELSE n - r END AS s FROM st JOIN it USING (k) WHERE n <= t)))
 )
 """
_PIECE = "SELECT id, CAST(no AS INT) AS piece_no, CAST(f + a - 1 AS INT) AS start_line, CAST(f + b - 1 AS INT) AS end_line{} FROM st JOIN it USING (k) WHERE no > 0"


@registry.query("p2_found", _P2 + _PIECE.format(""))
def p2_found(spark, d):
    items = split.chunk_items(table(spark, d, "chunks"), table(spark, d, "split_limits"))
    return split.split_oversized(items).select(F.col("item").alias("id"), "piece_no", "start_line", "end_line")


@registry.query("p6_ids")
def p6_ids(spark, d):
    return bpe.encode(table(spark, d, "documents"), bpe.vocabulary_path())


@registry.query(
    "p7_found",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[n:n+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS n FROM d WHERE len(w) >= 12)),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[n:n+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS n FROM i WHERE len(w) >= 12))
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """,
)
def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.query("p7_clean")
def p7_clean(spark, d):
    return leakage.remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@registry.query(
    "p4_found",
    """WITH v AS (SELECT CAST(id AS VARCHAR) AS id, min(vector) AS x FROM vector_rows WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda a: a IS NULL OR isnan(a) OR isinf(a))) = 0 AND len(list_filter(vector, lambda a: a <> 0)) > 0 GROUP BY 1),
    n AS (SELECT id, list_transform(x, lambda a: a::DOUBLE / sqrt(list_sum(list_transform(x, lambda b: b::DOUBLE * b::DOUBLE)))) AS u FROM v),
    r AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(greatest(-1, least(1, list_dot_product(a.u, b.u))), 9) DESC, b.id) AS rank FROM n a, n b WHERE a.id <> b.id)
    SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE rank <= 10""",
)
def p4_found(spark, d):
    return neighbours.similar_pairs(table(spark, d, "vector_rows"))


def _language_model(spark, d):
    return language.fit(table(spark, d, "lang_samples"), table(spark, d, "documents"))


@registry.query("p8_found")
def p8_found(spark, d):
    return language.mislabelled(table(spark, d, "documents"), _language_model(spark, d))


@registry.query("p8_labels")
def p8_labels(spark, d):
    return language.label_documents(table(spark, d, "documents"), _language_model(spark, d))


@registry.query("p8_segments")
def p8_segments(spark, d):
    return language.segments(table(spark, d, "documents"), _language_model(spark, d))


@registry.query("p3_found")
def p3_found(spark, d):
    return provenance.not_handwritten(table(spark, d, "scanned_files"))


@registry.query("p3_labels")
def p3_labels(spark, d):
    return provenance.label_files(table(spark, d, "scanned_files")).select("file_id", "label", F.round("p", 6).alias("p"))


def _sources(spark, d):
    return secrets.sources(table(spark, d, "scanned_files"), table(spark, d, "chunks"))


@registry.query("p5_found")
def p5_found(spark, d):
    return secrets.places(_sources(spark, d))


@registry.query("p5_redacted")
def p5_redacted(spark, d):
    return secrets.redacted(_sources(spark, d))


@registry.query("p2_texts", _P2 + _PIECE.format(", x AS text"))
def p2_texts(spark, d):
    items = split.chunk_items(table(spark, d, "chunks"), table(spark, d, "split_limits"))
    pieces = split.piece_texts(split.item_ranges(items))
    return pieces.select(F.col("item").alias("id"), "piece_no", "start_line", "end_line", "text")
