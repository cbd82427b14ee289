"""All queries of the library itself, by name, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import amounts, bundles, contracts, core, events, facts, findings, integrity, ranking, versions  # noqa: F401  (they register their queries)
from docketry.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items retrieve documents; the hits become assessed candidates."""
    return core.assessed_candidates(spark, sf_dir)


