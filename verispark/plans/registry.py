"""Registry of the queries with the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verispark.views import VIEWS, duckdb_cte

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_names(df: DataFrame) -> DataFrame:
    """Pivot columns named after models, with `_` for every other sign."""
    return df.toDF(*[re.sub("[^A-Za-z0-9_]", "_", c) for c in df.columns])


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query; `ctes` are shared WITH items, views are added where named."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            text = (ctes + " " + sql).strip()
            items = [duckdb_cte(v) for v in VIEWS if v in text]
            if ctes:
                items.append(ctes.strip().rstrip(","))
            ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(items) + "\n" if items else "") + sql.strip()
        return fn

    return add
