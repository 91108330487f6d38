"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.derived import DERIVED
from tidemark.sources.tables import spread

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the base tables and to the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def spread(self, name: str, *cols: str) -> DataFrame:
        """Columns of a base table for work that is heavy per row."""
        return spread(getattr(self, name).select(*cols))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL in which ``{name}`` is a base table or a derived view."""
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


def query(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``oracle`` is the equivalent SQL."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn

    return register


def with_views(body: str) -> str:
    """Prefix ``body`` with the derived views it mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in DERIVED:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(DERIVED[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', DERIVED[n])})" for n in needed)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
