"""The core's registered queries, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscale.operators import lexical
from folioscale.plans import answers, chunks, collections, documents, extraction, parts, search, streams, texts

MODULES = (search, documents, collections, texts, extraction, streams, answers, chunks, parts)


def _all() -> dict[str, tuple]:
    found: dict[str, tuple] = {}
    for module in MODULES:
        found |= module.queries()
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return lexical.evaluation_search(spark, root)
