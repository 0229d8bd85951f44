"""Feature filter and centred log-ratio on a sparse long table.

Only non-zero values are stored.  With ``u = ln(1 + value/pc)`` an absent pair
has u = 0, and the centred log-ratio over F retained features is

    clr = u - s,   s = (sum of u in the sample) / F,

so row means, moments and scores need the non-zero rows and counts only; the
samples x features grid is never built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.lineage import genus, species
from ..functions.stats import ratio
from ..session import spread
from .ranking import grouped_quantiles


def feature_landscape(samples: DataFrame, abundance: DataFrame, prevalence: float = 0.05,
                      min_cohorts: int = 3) -> DataFrame:
    """Prevalence, mean, maximum and cohort presence per feature, with the retain flag."""
    n = samples.agg(F.count(F.lit(1))).scalar()
    per_cohort = (
        abundance.join(samples.select("sample_id", "cohort"), "sample_id")
        .groupBy("feature", "cohort")
        .agg(F.sum((F.col("value") > 0).cast("bigint")).alias("positive"),
             F.sum("value").alias("total"), F.max("value").alias("top")))
    out = per_cohort.groupBy("feature").agg(
        (F.sum("positive") / n).alias("prevalence"),
        (F.sum("total") / n).alias("mean_abundance"),
        F.max("top").alias("max_abundance"),
        F.sum((F.col("positive") > 0).cast("bigint")).alias("cohorts_present"))
    return out.select(
        "feature", genus(F.col("feature")).alias("genus"), species(F.col("feature")).alias("species"),
        "prevalence", "mean_abundance", "max_abundance", "cohorts_present",
        ((F.col("prevalence") >= prevalence) & (F.col("cohorts_present") >= min_cohorts)).alias("retained"))


def landscape_summary(landscape: DataFrame) -> DataFrame:
    """Count and medians of retained against filtered features."""
    counts = landscape.groupBy("retained").agg(F.count(F.lit(1)).alias("n_features"))
    prevalence = grouped_quantiles(landscape, ["retained"], "prevalence", [0.5]).withColumnRenamed(
        "q0", "median_prevalence")
    abundance = grouped_quantiles(landscape, ["retained"], "mean_abundance", [0.5]).withColumnRenamed(
        "q0", "median_mean_abundance")
    return counts.join(prevalence, "retained").join(abundance, "retained")


def retained_features(landscape: DataFrame) -> DataFrame:
    return landscape.filter("retained").select("feature")


def keep_features(abundance: DataFrame, features: DataFrame) -> DataFrame:
    return abundance.join(features.select("feature"), "feature", "left_semi")


def pseudocount(abundance: DataFrame, multiplier: float = 0.5, fallback: float = 1e-6) -> DataFrame:
    """One row: the smallest positive value times ``multiplier``."""
    smallest = F.min(F.when(F.col("value") > 0, F.col("value")))
    return abundance.agg(F.coalesce(smallest * multiplier, F.lit(fallback)).alias("pseudocount"))


def shifted_logs(abundance: DataFrame, pc: Column) -> DataFrame:
    """Non-zero rows with ``u = ln(1 + value/pc)``."""
    return abundance.filter("value > 0").select("sample_id", "feature", "value", F.log1p(F.col("value") / pc).alias("u"))


def sample_centres(samples: DataFrame, logs: DataFrame, n_features: Column) -> DataFrame:
    """Every sample with its row mean ``s``; samples without non-zero rows have 0."""
    sums = logs.groupBy("sample_id").agg(F.sum("u").alias("_sum"))
    return (samples.join(sums, "sample_id", "left")
            .withColumn("s", F.coalesce("_sum", F.lit(0.0)) / n_features).drop("_sum"))


def clr_rows(samples: DataFrame, abundance: DataFrame, features: DataFrame, multiplier: float = 0.5) -> DataFrame:
    """The centred log-ratio of the non-zero rows; an absent pair has ``-s``."""
    kept = keep_features(abundance, features)
    logs = shifted_logs(kept, pseudocount(kept, multiplier).scalar())
    centres = sample_centres(samples, logs, features.agg(F.count(F.lit(1))).scalar())
    return logs.join(centres, "sample_id").withColumn("clr", F.col("u") - F.col("s"))


def dense_clr(samples: DataFrame, abundance: DataFrame, features: DataFrame, multiplier: float = 0.5) -> DataFrame:
    """Every sample as one array ``x`` in feature order, for the model fits.

    The array is as long as the retained feature list.
    """
    kept = keep_features(abundance, features)
    logs = shifted_logs(kept, pseudocount(kept, multiplier).scalar())
    names = features.agg(F.array_sort(F.collect_list("feature")).alias("_names"))
    places = names.select(F.posexplode("_names").alias("_i", "feature"))
    width = features.count()
    sparse = logs.join(places, "feature").groupBy("sample_id").agg(
        F.collect_list(F.struct("_i", "u")).alias("_entries"))
    rows = spread(samples.join(sparse, "sample_id", "left"), "sample_id").select(
        *samples.columns, F.coalesce(F.col("_entries._i"), F.array().cast("array<int>")).alias("_at"),
        F.coalesce(F.col("_entries.u"), F.array().cast("array<double>")).alias("_u"))
    schema = StructType([*samples.schema.fields, StructField("x", ArrayType(DoubleType()))])

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), width))
            if len(batch):
                line = np.repeat(np.arange(len(batch)), batch["_at"].map(len))
                x[line, np.concatenate(batch["_at"].to_numpy()).astype(int)] = np.concatenate(batch["_u"].to_numpy())
            x -= x.mean(axis=1, keepdims=True)
            yield batch.drop(columns=["_at", "_u"]).assign(x=list(x))

    return rows.mapInPandas(fill, schema)


def closure(abundance: DataFrame) -> DataFrame:
    """Proportions within a sample; a sample without mass has none."""
    totals = abundance.groupBy("sample_id").agg(F.sum("value").alias("_total"))
    return (abundance.join(totals, "sample_id")
            .withColumn("proportion", F.coalesce(ratio(F.col("value"), F.col("_total")), F.lit(0.0))).drop("_total"))


def ecology_scores(samples: DataFrame, abundance: DataFrame, panel: DataFrame, offset: float = 1e-5) -> DataFrame:
    """Shannon entropy, richness and panel abundance per sample, in one grouping.

    Entropy of proportions follows from sums: ln(T) - sum(v ln v)/T.
    """
    flagged = abundance.filter("value > 0").join(
        panel.select("feature", F.lit(True).alias("_in")), "feature", "left")
    inside = F.coalesce("_in", F.lit(False))
    sums = flagged.groupBy("sample_id").agg(
        F.sum("value").alias("_t"), F.sum(F.col("value") * F.ln("value")).alias("_tl"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(inside, F.col("value"))).alias("_pt"), F.sum(inside.cast("bigint")).alias("_pn"))
    panel_sum = F.coalesce("_pt", F.lit(0.0))
    return samples.join(sums, "sample_id", "left").select(
        *samples.columns,
        F.coalesce(F.ln("_t") - F.col("_tl") / F.col("_t"), F.lit(0.0)).alias("shannon"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("richness"),
        panel_sum.alias("panel_abundance"), F.log10(panel_sum + offset).alias("log10_panel_abundance"),
        F.coalesce("_pn", F.lit(0)).cast("bigint").alias("panel_richness"))
