"""All registered queries of the library, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..sources.tables import read_table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("relational", "ingestion", "retrieval", "graphs", "routing", "evaluation", "contracts", "events", "timeline", "collections", "comparison", "answers", "locators")


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with the SQL that gives the same rows."""

    def wrap(plan: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plan(Tables(spark, sf_dir))

        run.__doc__ = plan.__doc__
        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql.strip()
        return plan

    return wrap


def _load() -> None:
    for module in _MODULES:
        import_module(f".{module}", __package__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over the documents of a folder."""
    return queries()["hybrid_merge_dedupe"](spark, sf_dir)
