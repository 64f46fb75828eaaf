"""Entities of a manifest scored against questions by shared words and names.

Points of a question and an entity, whose case does not count: 10 if the question contains
the whole name (3 letters and more), 7 for every part of a dotted name that it
contains (3 letters and more), 3 if it contains the module; per pair of a word of the question and a
word of the name 5 if they are equal (3 letters and more), 2 if one is part of
the other (4 letters and more); 1 per equal word of the description or the path (4 letters and more).
Words that stand repeatedly count repeatedly.

Nothing is compared pair by pair: words meet in equi-joins, and a text meets what it
contains by the first letters of the shorter one (``GRAM`` at most), which must be among the letter
groups of the longer one; only such candidates are checked.

Defined edge cases: null names, modules, descriptions and paths, and empty ones, give no points;
repeated entities count once; questions without points have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
GRAM = 6


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def containing(longs: DataFrame, shorts: DataFrame, least: int = 1) -> DataFrame:
    """Pairs ``(long, short)`` of the distinct values of both columns in which ``long`` contains ``short``, ``least`` letters and more."""
    some = shorts.where(F.length("short") >= least).select("short").distinct().withColumn("gram", F.substring("short", 1, GRAM))
    groups = lambda n: F.when(F.length("long") >= n, F.transform(F.sequence(F.lit(1), F.length("long") - n + 1), lambda i: F.substr("long", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = longs.select("long").where("long <> ''").distinct().select("long", F.explode(F.array_distinct(F.concat(*(groups(n) for n in range(min(least, GRAM), GRAM + 1))))).alias("gram"))
    return grams.join(some, "gram").where(F.contains("long", "short")).select("long", "short")


def counted(rows: DataFrame, key: str, text: Column, name: str, n: str) -> DataFrame:
    return rows.select(key, F.explode(words(text)).alias(name)).groupBy(key, name).agg(F.count("*").alias(n))


def score(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """``query_id, id, score`` of ``queries(query_id, text)`` and ``entities(id, name, module, description, path)``, scores above 0."""
    q = queries.where("text is not null").select("query_id", F.lower("text").alias("long"))
    e = entities.select("id", *(F.lower(x).alias(x) for x in ("name", "module", "description", "path"))).distinct()
    asked = counted(q, "query_id", c("long"), "word", "nq")
    named = counted(e, "id", c("name"), "name_word", "ne")

    # pairs of words are weighed once, however many questions and entities have them
    mine, theirs = asked.select("word").distinct(), named.select("name_word").distinct()
    same = mine.where(F.length("word") > 2).join(theirs, c("word") == c("name_word")).select("word", "name_word", F.lit(5).alias("points"))
    inside = containing(theirs.select(c("name_word").alias("long")), mine.select(c("word").alias("short")), 4).select(c("short").alias("word"), c("long").alias("name_word"))
    around = containing(mine.select(c("word").alias("long")), theirs.select(c("name_word").alias("short")), 4).select(c("long").alias("word"), c("short").alias("name_word"))
    part = inside.unionByName(around).where("word <> name_word").select("word", "name_word", F.lit(2).alias("points"))
    of_words = asked.join(same.unionByName(part), "word").join(named, "name_word").select("query_id", "id", (c("nq") * c("ne") * c("points")).alias("points"))

    # names, parts of names and modules inside the question
    parts = e.where(F.contains("name", F.lit("."))).select("id", F.explode(F.split("name", "\\.")).alias("short"))
    sought = (
        e.where(F.length("name") > 2).select("id", c("name").alias("short"), F.lit(10).alias("points"))
        .unionByName(parts.where(F.length("short") > 2).select("id", "short", F.lit(7).alias("points")))
        .unionByName(e.where("module <> ''").select("id", c("module").alias("short"), F.lit(3).alias("points")))
    )
    found = containing(q, sought).join(q, "long").select("query_id", "short").join(sought, "short").select("query_id", "id", c("points").cast("long").alias("points"))

    text = counted(e, "id", c("description"), "word", "ne").unionByName(counted(e, "id", c("path"), "word", "ne")).where(F.length("word") > 3)
    of_text = asked.join(text, "word").select("query_id", "id", (c("nq") * c("ne")).alias("points"))
    return of_words.unionByName(found).unionByName(of_text).groupBy("query_id", "id").agg(F.sum("points").alias("score"))
