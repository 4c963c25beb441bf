"""Registry of the lineage and entity-resolution queries: name -> (query, DuckDB oracle or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator that files a query under its operator's name, with its oracle where SQL has one."""

    def file(query: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered twice")
        _REGISTRY[name] = (query, oracle)
        return query

    return file


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in ("text", "relational", "graph", "scoring", "quality", "sources"):
        importlib.import_module(f"heddle.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return {k: q for k, (q, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _REGISTRY.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["win_rank_subtree"](spark, sf_dir)
