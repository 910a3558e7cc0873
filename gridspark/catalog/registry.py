"""Registration of queries and the rounding both sides share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.catalog.fixtures import with_views

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; the SQL may use the fixture views E, H, L, D, Z and F by name."""
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = Query(name, build, None if sql is None else with_views(sql))
        return build
    return register


# Share of the last digit that is added before rounding on both sides.  Means of decimal numbers often lie
# exactly half way between two roundings, where the last bit of a sum decides; the shift moves them off.
SHIFT = 0.0137


def rd(col: Column | str, digits: int = 6) -> Column:
    value = F.col(col) if isinstance(col, str) else col
    return F.round(value + SHIFT * 10.0 ** -digits, digits)


def r(expr: str, digits: int = 6) -> str:
    """The same rounding in SQL; adding zero turns a negative zero into zero."""
    return f"(round(CAST({expr} AS DOUBLE) + {SHIFT} * 1e-{digits}, {digits}) + 0.0)"


def ts(col: str = "time") -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def sts(expr: str = "time") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def hash_sql(*parts: str) -> str:
    """The 32-bit draw of ``seeded_hash`` in SQL."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
