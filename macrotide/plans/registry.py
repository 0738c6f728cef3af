"""Queries over the driver's tables, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.functions.shipping import ship

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query of (spark, sf_dir) under a name, with the SQL that gives the same rows, if there is one."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            out = function(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("long") for c in ("place", "fold") if c in out.columns})  # as SQL engines count rows

        _QUERIES[name] = run
        if sql:
            _ORACLES[name] = sql
        return function

    return add


def _load() -> None:
    from macrotide.plans import contract_queries, control_queries, design_queries, disaggregation_queries, evidence_queries, extra_queries, instrument_queries, panel_queries, policy_queries, regression_queries, result_queries, screen_queries, shock_queries, source_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
