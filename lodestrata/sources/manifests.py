"""Package manifests: ``(repo_name, content)`` to ``(repo_name, package_name, dependencies, dev_dependencies)``.

Contents that do not parse give null names and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
_NONE = "cast(array() as array<string>)"


def package_json(files: DataFrame) -> DataFrame:
    keys = lambda path: F.coalesce(F.json_object_keys(F.get_json_object("content", path)), F.expr(_NONE))
    return files.select("repo_name", F.get_json_object("content", "$.name").alias("package_name"), keys("$.dependencies").alias("dependencies"), keys("$.devDependencies").alias("dev_dependencies"))


def go_mod(files: DataFrame) -> DataFrame:
    blocks = F.array_join(F.regexp_extract_all("content", F.lit(r"(?s)require\s*\(([^)]*)\)"), F.lit(1)), "\n")
    listed = F.regexp_extract_all(blocks, F.lit(r"(?m)^\s*([^\s/][^\s]*)\s+v"), F.lit(1))
    single = F.regexp_extract_all("content", F.lit(r"(?m)^require\s+([^\s(]+)\s+v"), F.lit(1))
    name = F.nullif(F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1), F.lit(""))
    return files.select("repo_name", name.alias("package_name"), F.array_distinct(F.concat(single, listed)).alias("dependencies"), F.expr(_NONE).alias("dev_dependencies"))


def _section(name: str) -> Column:
    """Keys of a TOML table, up to the next table."""
    body = F.regexp_extract("content", rf"(?ms)^\[{name}\]\s*\n(.*?)(?=^\[|\z)", 1)
    return F.regexp_extract_all(body, F.lit(r"(?m)^\s*\"?([^\s=\"#]+)\"?\s*="), F.lit(1))


def cargo_toml(files: DataFrame) -> DataFrame:
    package = F.regexp_extract("content", r"(?ms)^\[package\]\s*\n(.*?)(?=^\[|\z)", 1)
    name = F.nullif(F.regexp_extract(package, r"(?m)^\s*name\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    return files.select("repo_name", name.alias("package_name"), _section("dependencies").alias("dependencies"), _section("dev-dependencies").alias("dev_dependencies"))
