"""The package's operators applied to the given tables: a query and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    """Queries by name. ``parts`` are named SQL tables that the SQL of queries may refer to; those that a text needs,
    directly or through others, are put before it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.parts: dict[str, tuple[tuple[str, ...], str]] = {}

    def part(self, name: str, body: str, *needs: str) -> None:
        self.parts[name] = needs, body

    def compose(self, body: str, *needs: str) -> str:
        order: list[str] = []

        def add(name: str) -> None:
            for n in self.parts[name][0]:
                add(n)
            if name not in order:
                order.append(name)

        for name in needs:
            add(name)
        if not order:
            return body
        return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({self.parts[n][1]})" for n in order) + "\n" + body

    def add(self, name: str, sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = self.compose(sql, *needs)
            return query

        return register


SUITE = Suite()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
