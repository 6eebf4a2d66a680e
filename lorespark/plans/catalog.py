"""The catalog of named queries: a Spark plan and its SQL for each."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables, with_tables


class Query(NamedTuple):
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


CATALOG: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register ``plan(tables)`` under its name; ``covers`` names the operators of
    the survey that it exercises."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if plan.__name__ in CATALOG:
            raise ValueError(f"{plan.__name__} is registered twice")
        CATALOG[plan.__name__] = Query(lambda spark, sf_dir: plan(Tables(spark, sf_dir)), with_tables(sql) if sql else None, covers)
        return plan

    return register
