"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("metric_queries", "grading_queries", "resample_queries", "pairwise_queries", "caseset_queries", "planning_queries", "disclosure_queries", "record_queries", "report_queries", "evaluation_queries", "artifact_queries", "manifest_queries", "provenance_queries", "admission_queries", "hygiene_queries")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict = {}
    for name in _MODULES:
        out |= import_module(f"tallyframe.plans.{name}").QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
