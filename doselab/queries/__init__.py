"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from doselab.queries import core, stats  # noqa: F401 - stats registers its own

    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    from doselab.queries import core, stats  # noqa: F401 - stats registers its own

    return dict(core.ORACLE)
