"""Registered queries: name → (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from aeroband.plans import views
from aeroband.session import ensure_utc


@dataclass
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name domain views, which become CTEs."""

    def wrap(fn):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return wrap


def _zone_free(df: DataFrame) -> DataFrame:
    """Timestamps leave a query as UTC wall-clock values."""
    if not any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
        return df
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return _zone_free(ENTRIES[name].build(spark, sf_dir))


def with_views(sql: str) -> str:
    """Prefix the domain views a statement uses, dependencies first."""
    needed: list[str] = []

    def visit(text: str):
        for view, body in views.SQL.items():
            if view not in needed and re.search(rf"\b{view}\b", text):
                visit(body)
                if view not in needed:
                    needed.append(view)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{v} AS ({views.SQL[v]})" for v in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
