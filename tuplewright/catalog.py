"""The registered queries of the engine's own operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("tuplewright.operators.idioms", "tuplewright.operators.recursive", "tuplewright.operators.programs", "tuplewright.operators.client_programs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(m).QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= import_module(m).ORACLES
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of the parts' forest, by the rule engine."""
    from tuplewright.operators import recursive

    return recursive.ancestors_linear(spark, sf_dir)
