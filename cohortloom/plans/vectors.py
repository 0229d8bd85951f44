"""Dense data derived from the embeddings: one score per (vector, dimension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .basket import table

_BUILT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def vector_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, cohort, condition, x): cohort by key, condition by label."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.concat(F.lit("c"), F.col("vec_id") % 5).alias("cohort"),
        (F.col("label") >= 5).cast("int").alias("condition"), F.col("embedding").cast("array<double>").alias("x"))


def vector_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Samples and long scores (sample_id, feature, score) of the vectors."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _BUILT:
        profiles = vector_profiles(spark, folder)
        scores = profiles.select("sample_id", F.posexplode("x").alias("_d", "score")).select(
            "sample_id", F.format_string("d%02d", F.col("_d") + 1).alias("feature"), "score")
        _BUILT[key] = (settle(profiles.drop("x")), settle(scores))
    return _BUILT[key]
