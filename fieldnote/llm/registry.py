"""The queries of this folder: a name, a job over whole tables, and where one exists the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return register
