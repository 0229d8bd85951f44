"""The registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .analysis import CohortAnalysis
from .basket import MIN_COHORTS, PREVALENCE, baskets, token_shares
from .oracle import ORACLE, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_ANALYSES: dict[tuple[str, str, str], CohortAnalysis] = {}


def register(name: str, oracle: str | None = None, data: str = "fine") -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = sql(oracle, data)
        return function
    return add


def analysis(spark: SparkSession, folder: str, data: str = "fine") -> CohortAnalysis:
    """The basket analysis of a folder; its tables are shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, folder, data)
    if key not in _ANALYSES:
        baskets_ = baskets(spark, folder, data)
        _ANALYSES[key] = CohortAnalysis(baskets_.samples, baskets_.abundance, PREVALENCE, MIN_COHORTS)
    return _ANALYSES[key]


def forget_analyses() -> None:
    _ANALYSES.clear()


def document_analysis(spark: SparkSession, folder: str) -> CohortAnalysis:
    """Labelled documents: cohort = language, condition = quality, feature = token."""
    key = (spark.sparkContext.applicationId, folder, "documents")
    if key not in _ANALYSES:
        data = token_shares(spark, folder)
        _ANALYSES[key] = CohortAnalysis(data.samples, data.abundance, 0.05, 1)
    return _ANALYSES[key]
