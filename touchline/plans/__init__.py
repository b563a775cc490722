"""Queries for each operator, on views of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from touchline.plans import aggregates, identity, joins, motion, reports, scalars, scans, streams, teams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from touchline.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from touchline.plans.registry import ORACLE

    _load()
    return dict(ORACLE)
