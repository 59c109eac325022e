"""Every registered query over the reference operators, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, cue_queries, entity_queries, evidence_queries, fold_queries, job_queries, ledger_queries, retime_queries, rework_queries, store_queries

MODULES = [cue_queries, evidence_queries, fold_queries, job_queries, store_queries, rework_queries, audit_queries, retime_queries, entity_queries, ledger_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_queries.source_quality(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
