"""All queries by name, and their equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import collections, misc, trees, versions

_ALL = versions.QUERIES | collections.QUERIES | trees.QUERIES | misc.QUERIES
QUERIES = {name: f for name, (f, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold rule of line items for their return flag."""
    return trees.rul1_best_rule(spark, sf_dir)
