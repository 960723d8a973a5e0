"""Registry of checked queries: a Spark builder and, where SQL can say it,
an independent DuckDB oracle for the same fixture tables.

Conventions for the pairs: every computed column is aliased to the same
name on both sides; doubles are rounded on both sides; integers are BIGINT
on both sides; dates and timestamps are rendered as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    name: str
    build: Builder
    oracle: str | None
    group: str


_CHECKS: dict[str, Check] = {}


def check(name: str, oracle: str | None = None, group: str = ""):
    """Decorator registering ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def wrap(fn: Builder) -> Builder:
        if name in _CHECKS:
            raise ValueError(f"duplicate check {name}")
        _CHECKS[name] = Check(name, fn, oracle.strip() if oracle else None, group or name.split("_")[0])
        return fn

    return wrap


def all_checks() -> dict[str, Check]:
    # Importing the modules registers their checks.
    from . import (  # noqa: F401
        ingest_checks,
        profile_checks,
        overview_checks,
        retrieval_checks,
        sql_surface,
        rollup_checks,
        display_checks,
        answer_checks,
    )

    return dict(_CHECKS)
