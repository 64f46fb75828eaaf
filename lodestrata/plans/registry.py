"""Registry that keeps a query and its SQL statement side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestrata.shipping import ship

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    fns: dict[str, QueryFn] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
        """Register ``fn`` under ``name``; ``sql`` is absent where SQL cannot state the operator."""

        def add(fn: QueryFn) -> QueryFn:
            if name in self.fns:
                raise ValueError(f"query {name} is registered twice")

            @wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return fn(spark, sf_dir)

            self.fns[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add

    def merge(self, other: "Registry") -> None:
        for name, fn in other.fns.items():
            self.query(name, other.sql.get(name))(fn)
