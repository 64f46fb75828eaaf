"""Connectors: pages and work items of remote services, from landed JSON.

Responses are fetched by a scheduler and landed as JSON lines; here they get
schemas, text and keys. Object stores need no code: paths of ``s3a://``, ``abfss://``
and ``gs://`` work wherever a path is taken. ``LandedPages`` is a Python data source
that reads a folder of landed pages as a batch or, by file name, as a stream.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestrata.functions.text import html_to_text

c = F.col
PAGE = "id string, title string, space string, version int, updated_at timestamp, ancestors array<string>, body string"
SITE_PAGE = "id string, title string, webUrl string, lastModifiedDateTime timestamp, webParts array<struct<innerHtml: string, data: struct<title: string, description: string>>>"
ITEM = "id string, externalId string, title string, description string, type string, state string, assignedTo string, tags array<string>, url string"


def pages(lines: DataFrame, since: str | None = None) -> DataFrame:
    """``page_id, title, space, version, updated_at, path, text``: the last version of each page, changed at or after ``since``."""
    rows = lines.select(F.from_json("value", PAGE).alias("p")).select("p.*").where("id is not null")
    if since is not None:
        rows = rows.where(c("updated_at") >= F.lit(since).cast("timestamp"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "space", "version", "updated_at", "ancestors", "body"), F.struct("version", "updated_at")).alias("p"))
    path = F.concat_ws("/", F.lit("confluence"), "p.space", F.array_join("p.ancestors", "/"), "p.title")
    return last.select(c("id").alias("page_id"), "p.title", "p.space", "p.version", "p.updated_at", path.alias("path"), html_to_text(c("p.body")).alias("text"))


def site_pages(lines: DataFrame, since: str | None = None) -> DataFrame:
    """``page_id, title, url, updated_at, text`` of landed site pages: the last version of each, changed at or after ``since``; web parts are joined in order."""
    rows = lines.select(F.from_json("value", SITE_PAGE).alias("p")).select("p.*").where("id is not null")
    if since is not None:
        rows = rows.where(c("lastModifiedDateTime") >= F.lit(since).cast("timestamp"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "webUrl", "lastModifiedDateTime", "webParts"), F.struct("lastModifiedDateTime", "webUrl")).alias("p"))
    html = F.array_join(F.filter(F.transform("p.webParts", lambda x: F.coalesce(x["innerHtml"], F.concat_ws(" ", x["data"]["title"], x["data"]["description"]))), lambda x: x != ""), "<br/>")
    return last.select(c("id").alias("page_id"), "p.title", c("p.webUrl").alias("url"), c("p.lastModifiedDateTime").alias("updated_at"), html_to_text(F.coalesce(html, F.lit(""))).alias("text"))


def work_items(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.from_json("value", ITEM).alias("i")).select("i.*").where("id is not null")
    return rows.select("id", c("externalId").alias("external_id"), "title", "description", "type", "state", c("assignedTo").alias("assigned_to"), "tags", "url")


class _Page(InputPartition):
    def __init__(self, name: str):
        self.name = name


def _folder(path: str):
    """The file system of a folder and the folder's place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _names(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _folder(path)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith((".", "_")))


def _rows(path: str, name: str) -> Iterator[tuple]:
    system, at = _folder(path)
    with system.open_input_stream(f"{at.rstrip('/')}/{name}") as raw, io.TextIOWrapper(raw, encoding="utf-8") as lines:
        for line in lines:
            try:
                page = json.loads(line)
            except ValueError:
                continue
            if isinstance(page, dict):
                yield name, page.get("id"), line.rstrip("\n")


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [_Page(n) for n in _names(self.folder)]

    def read(self, partition):
        return _rows(self.folder, partition.name)


class LandedStream(DataSourceStreamReader):
    """The offset is the name of the last file, as names grow with time; the driver lists names, and each new file is a partition that a worker reads."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max(_names(self.folder), default="")}

    def partitions(self, start, end):
        return [_Page(n) for n in _names(self.folder) if start["after"] < n <= end["after"]]

    def read(self, partition):
        return _rows(self.folder, partition.name)


class LandedPages(DataSource):
    """``spark.dataSource.register(LandedPages)``, then ``spark.read.format("landed_pages").load(folder)``; the folder is one that all executors share."""

    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return "file string, id string, value string"

    def reader(self, schema):
        return LandedReader(self.options["path"])

    def streamReader(self, schema):
        return LandedStream(self.options["path"])
