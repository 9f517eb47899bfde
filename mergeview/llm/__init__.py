"""Operators for preparing training data.  Nothing else in the library imports this subpackage.

queries() and oracle_sql() give what __spark_entry__.py adds to its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _modules():
    from mergeview.llm.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_modules()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_modules()[1])
