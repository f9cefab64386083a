"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from survperf.plans import oracle
from survperf.plans import queries as plans

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(plans.REGISTERED)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
