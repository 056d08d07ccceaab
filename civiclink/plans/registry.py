"""Registered queries: a Spark callable over the given tables and, where SQL can say the same,
its SQL twin. Views shared by both sides are written once in SQL that both engines read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}
_SCHEMAS: dict[str, StructType] = {}


def view(name: str, sql: str) -> None:
    """A derived table; {x} in its text stands for the given table or earlier view x."""
    VIEWS[name] = sql


def _needs(sql: str) -> list[str]:
    return re.findall(r"\{([a-z_0-9]+)\}", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Given table or derived view as a DataFrame."""
    if name in TABLES:
        # The schema is read from the files once per process and declared afterwards.
        path = f"{sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        return spark.read.schema(_SCHEMAS[path]).parquet(path)
    sql = VIEWS[name]
    used = {n: table(spark, sf_dir, n) for n in dict.fromkeys(_needs(sql))}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """SQL text for the other engine: the views it needs become common table expressions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in ordered:
                visit(VIEWS[n])
                if n not in ordered:
                    ordered.append(n)

    visit(sql)
    bare = lambda text: re.sub(r"\{([a-z_0-9]+)\}", r"\1", text)
    if not ordered:
        return bare(sql)
    ctes = [f"{n} AS ({bare(VIEWS[n])})" for n in ordered]
    body = bare(sql).strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + body


def query(name: str, sql: str | None = None):
    """Register a function of a table loader: f(t) where t('orders') is a DataFrame."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda n: table(spark, sf_dir, n))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duck(sql)
        return build

    return register
