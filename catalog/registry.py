"""Registration of a query with its oracle, and the number format both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import Tables, with_views
from lakesurvey.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Doubles are compared on a grid of 1/10000. The offset keeps decimal halves, which sums and means
# of cents often hit, away from the edge between two grid values.
GRID, OFFSET = 10000, 0.4137


def snap(c: Column | str, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.floor(col * GRID + OFFSET) / GRID
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def snap_sql(expr: str, name: str | None = None) -> str:
    out = f"FLOOR(({expr}) * {GRID} + {OFFSET}) / {GRID}"
    return f"{out} AS {name or expr}" if (name or expr.isidentifier()) else out


def snapped(df: DataFrame) -> DataFrame:
    """All double columns on the grid."""
    return df.select(*[snap(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None, *, raw: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``raw`` SQL brings its views along."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            ORACLES[name] = sql if raw else with_views(sql)
        return fn

    return register


def lit_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
