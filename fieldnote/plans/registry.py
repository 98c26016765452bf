"""The registered queries: a name, a Spark job over whole tables, and where one exists the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    job: Job
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(job, sql)
        return job

    return register


def load() -> dict[str, Query]:
    """All queries. Importing a module of queries registers them."""
    from fieldnote.plans import (  # noqa: F401
        catalog_answers,
        catalog_clean,
        catalog_coding,
        catalog_counts,
        catalog_ingest,
        catalog_statistics,
    )

    return QUERIES
