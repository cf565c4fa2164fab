"""Named queries and, where SQL can say the same thing, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def sql_view(name: str, needs: tuple[str, ...], sql: str) -> None:
    """A common table expression that check SQL can ask for by name."""
    SQL_VIEWS[name] = (needs, sql.strip())


def _with_clause(needs: tuple[str, ...]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        deps, _ = SQL_VIEWS[name]
        for dep in deps:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in ordered) + "\n"


def _plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and fractions as DOUBLE, so results compare."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DecimalType)):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: _plain_types(fn(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = _with_clause(needs) + sql.strip()
        return fn

    return register
