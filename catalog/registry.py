"""Registry of queries and their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import CHECK_CTES, TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
        for t in used:
            text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" in VIEWS:
            return self.view(f"v_{name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def _needed(sql: str, found: list[str]) -> list[str]:
    """Names of the CTEs a query uses, inner ones first."""
    known = {**VIEWS, **CHECK_CTES}
    for name, body in known.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def check_sql(body: str) -> str:
    known = {**VIEWS, **CHECK_CTES}
    names = _needed(body, [])
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in names)
    extra = body.strip()
    if extra.upper().startswith("WITH "):
        return f"WITH {ctes},\n{extra[5:]}"
    return f"WITH {ctes}\n{extra}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; without ``sql`` only the row count is checked."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = check_sql(sql)
        return fn

    return register
