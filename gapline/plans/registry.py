"""The table of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.plans.views import VIEWS, view_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``{aln}`` in the SQL stands for the view ``aln``."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            text = sql
            for name in VIEWS:
                text = text.replace("{" + name + "}", f"{view_sql(name)} AS {name}")
            _SQL[f.__name__] = text
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def six(c: Column, name: str) -> Column:
    """The column rounded to six places, since sums of floating numbers depend on their order."""
    return F.round(c, 6).alias(name)
