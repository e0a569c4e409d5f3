"""The registered queries: name, Spark form and SQL for a second engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(names: str, rows: list[tuple]) -> str:
    """SQL of a table of literals: text, numbers, booleans, lists of text and None."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list | tuple):
            return "[" + ", ".join(map(literal, v)) + "]::VARCHAR[]"
        if isinstance(v, str):
            return " || ".join(f"chr({ord(p)})" if p in "\n\r\t" else "'" + p.replace("'", "''") + "'" for p in re.split("([\n\r\t])", v) if p) or "''"
        return repr(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") t({names})"
