"""Named queries over the test tables, each with the SQL it must agree with.

``columns`` lists the output as ``name:kind``; both engines project through the same
list (d date, i bigint, f double rounded to 6, g double rounded to 2, s text, b bool),
so a query and its SQL cannot differ in names, types or rounding.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.tables import ORACLE_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

# (digits, nudge): prices divide by small integers, so exact ties at the last digit are
# common and engines round them differently; the same nudge in both moves off the tie.
ROUNDING = {"f": (6, 3.7e-8), "g": (2, 2.3e-4)}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""
    spec = tuple(tuple(item.split(":")) for item in columns.split())

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, spec, build, sql)
        return build

    return register


def _spark_out(df: DataFrame, spec) -> DataFrame:
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in "fg":
            x = c.cast("double")
            x = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
            digits, nudge = ROUNDING[kind]
            c = F.round(x + F.lit(nudge), digits) + F.lit(0.0)
        elif kind != "x":
            c = c.cast({"d": "date", "i": "bigint", "s": "string", "b": "boolean"}[kind])
        return c.alias(name)

    return df.select(*[one(n, k) for n, k in spec])


def _duck_out(spec) -> str:
    def one(name: str, kind: str) -> str:
        if kind in "fg":
            digits, nudge = ROUNDING[kind]
            return (
                f"CASE WHEN isfinite(CAST({name} AS DOUBLE)) "
                f"THEN round(CAST({name} AS DOUBLE) + {nudge}::DOUBLE, {digits}) + 0.0 END AS {name}"
            )
        if kind == "x":
            return name
        kinds = {"d": "DATE", "i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}
        return f"CAST({name} AS {kinds[kind]}) AS {name}"

    return ", ".join(one(n, k) for n, k in spec)


def with_views(body: str) -> str:
    """Prefix the CTEs a statement mentions, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name, sql in ORACLE_VIEWS.items():
            if name not in order and re.search(rf"\b{name}\b", text):
                need(sql)
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in order) + "\n" + body


def spark_query(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _spark_out(q.build(Tables(spark, sf_dir)), q.columns)


def oracle_query(q: Query) -> str:
    return with_views(f"SELECT {_duck_out(q.columns)} FROM (\n{q.sql}\n) AS result_rows")


def load() -> dict[str, Query]:
    import importlib

    for module in (
        "market", "joins", "aggregates", "windows", "ranking", "pit_queries", "research",
        "allocation", "execution_tables", "quality", "integrity", "catalog_queries", "scalars_and_sources", "bundles",
    ):
        importlib.import_module(f"registry.{module}")
    return QUERIES
