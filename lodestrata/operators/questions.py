"""Questions from templates over entities, with the entities that answer them.

``entities(id, name, kind, module, file_path, parent, description)`` and ``edges(source, target, type)``
whose ends are paths or ``path#name``. Every entity takes part; answers stand in long form, one
row each, so a module of any size is no group that must fit one task.

Defined edge cases: entities without a name ask nothing by name; null modules and descriptions ask
nothing; repeated entities and edges count once; a template whose entities are absent gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

#: fixed values: templates by name: wording, category, difficulty
TEMPLATES = {
    "function_lookup": ("Find the {name} function", "function_lookup", "easy"),
    "class_lookup": ("Show the {name} class", "function_lookup", "easy"),
    "interface_lookup": ("Where is the {name} interface defined", "function_lookup", "easy"),
    "test_finding": ("Find the tests for {name}", "concept_search", "medium"),
    "concept_module": ("How does the {module} module work", "concept_search", "medium"),
    "usage": ("What uses {name}", "cross_file", "medium"),
    "relationship": ("How does {name} relate to {other} in the {module} module", "cross_file", "hard"),
    "method_lookup": ("Find the {name} method on {parent}", "function_lookup", "easy"),
    "error_investigation": ("How does the {module} module handle validation and errors", "error_investigation", "hard"),
    "import_chain": ("What does {file} import from other modules", "cross_file", "medium"),
    "description_search": ("{description}", "concept_search", "medium"),
    "service_overview": ("List all services in the {module} domain", "concept_search", "medium"),
    "class_overview": ("List all classes in the {module} domain", "concept_search", "medium"),
}
TEST = r"(?:\.(?:test|spec)\.[^./]+|_test\.[^./]+)\z"


def _of(template: str, rows: DataFrame, expected: str | Column = "id", **values: str | Column) -> DataFrame:
    wording, category, difficulty = TEMPLATES[template]
    text = F.lit(wording)
    for key in ("description", "parent", "other", "name", "module", "file"):
        if key in values:
            text = F.replace(text, F.lit("{" + key + "}"), c(values[key]) if isinstance(values[key], str) else values[key])
    answer = c(expected) if isinstance(expected, str) else expected
    return rows.select(F.lit(template).alias("template"), text.alias("query"), F.lit(category).alias("category"), F.lit(difficulty).alias("difficulty"), answer.alias("expected_id")).where("query is not null and expected_id is not null")


def questions(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``template, query, category, difficulty, expected_id``."""
    every = entities.select("id", "name", "kind", "module", "file_path", "parent", "description").distinct()
    named = every.where("name <> ''")
    kinds = lambda *x: named.where(c("kind").isin(*x))
    links = edges.where("source <> '' and target <> ''").select("source", "target", "type").distinct()

    tests = every.where(c("file_path").rlike(TEST)).select(F.regexp_replace("file_path", r"(?:\.(?:test|spec)|_test)(\.[^./]+)\z", "$1").alias("file_path"), c("id").alias("test_id"))
    tested = named.where(~c("file_path").rlike(TEST)).join(tests, "file_path").select("name", F.explode(F.array("id", "test_id")).alias("answer"))
    used = named.withColumn("target", F.concat("file_path", F.lit("#"), "name")).join(links, "target")
    # neighbours by name within one file, so no pair is listed twice and no module is sorted in one task
    beside = kinds("class").withColumn("other", F.lead("name").over(Window.partitionBy("file_path").orderBy("name", "id"))).where("other <> name")
    body = kinds("class", "function").where("module is not null")
    careful = body.where(F.lower("name").contains("validate") | F.lower(F.coalesce("description", F.lit(""))).rlike("validate|filter|parse"))
    plain = body.join(careful.select("module").distinct(), "module", "left_anti")
    classes = kinds("class").where("module is not null")
    services = classes.where(c("name").contains("Service"))
    others = classes.join(services.select("module").distinct(), "module", "left_anti")
    imports = links.where("type = 'imports'").select(c("source").alias("file_path"), "target")
    importing = every.select("file_path").distinct().join(imports, "file_path")

    parts = [
        _of("function_lookup", kinds("function"), name="name"),
        _of("class_lookup", kinds("class"), name="name"),
        _of("interface_lookup", kinds("interface"), name="name"),
        _of("test_finding", tested, "answer", name="name"),
        _of("concept_module", body, module="module"),
        _of("usage", used, "source", name="name"),
        _of("relationship", beside.withColumn("answer", c("id")), "answer", name="name", other="other", module="module"),
        _of("method_lookup", kinds("method").where("parent <> ''"), name="name", parent="parent"),
        _of("error_investigation", careful.unionByName(plain), module="module"),
        _of("import_chain", importing, "target", file=F.regexp_extract("file_path", r"([^/]+)\z", 1)),
        _of("description_search", every.where("description <> ''"), description="description"),
        _of("service_overview", services, module="module"),
        _of("class_overview", others, module="module"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
