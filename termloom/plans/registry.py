"""All queries of the core library with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.plans import evaluation_queries, hierarchy_queries, lane_queries, resolution_queries

_MODULES = [hierarchy_queries, resolution_queries, evaluation_queries, lane_queries]


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.SQL)
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy_queries.p1_hierarchy(spark, sf_dir)
