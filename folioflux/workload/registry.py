"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflux.session import ship_package
from folioflux.workload.ersql import ER_VIEWS
from folioflux.workload.sqltext import SQL_VIEWS
from folioflux.workload.tables import VIEWS as TABLE_VIEWS
from folioflux.workload.tables import Tables

VIEWS = {**TABLE_VIEWS, **SQL_VIEWS, **ER_VIEWS}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix the SQL with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, definition in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
                visit(definition)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL if it has one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
