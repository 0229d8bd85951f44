"""Sensitivity sweeps: the settings are rows, so a sweep is one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import sign
from ..session import settle
from .composition import keep_features
from .moments import clr_moments, cohort_counts, cohort_list, design_weights, leave_one_out_designs, pooled_design, screen
from .ranking import bh_adjust
from .stability import median_stability

# The settings of the sweeps.
FILTER_PREVALENCE = (0.03, 0.05, 0.10)
FILTER_COHORTS = (2, 3, 4)
PSEUDOCOUNT_MULTIPLIERS = (0.25, 0.50, 1.00)
FDR_CUTOFFS = (0.05, 0.10)
STABILITY_THRESHOLDS = (0.50, 0.60, 0.70, 0.80)


def _top(assoc: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(
        F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "feature")
    return assoc.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).select(*keys, "feature")


def config_screens(samples: DataFrame, abundance: DataFrame, features: DataFrame, config: DataFrame) -> DataFrame:
    """The pooled screen of every configuration, q values within it."""
    moments = clr_moments(samples, abundance, features, config=config)
    fitted = screen(moments, design_weights(pooled_design(cohort_counts(samples))), ["config_id"])
    return bh_adjust(fitted.drop("design_id"), "pvalue", "qvalue", ["config_id"])


def against_baseline(screens: DataFrame, baseline: DataFrame, gaps: DataFrame, top_k: int = 100) -> DataFrame:
    """Counts of a configuration's screen and its agreement with the baseline screen."""
    stability = median_stability(gaps, screens, ["config_id"]).select("config_id", "feature", "stability_fraction")
    base = baseline.select("feature", F.col("coef").alias("_base"), F.lit(True).alias("_common"))
    base_top = baseline.orderBy(F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "feature").limit(
        top_k).select("feature", F.lit(1).alias("_base_top"))
    own_top = _top(screens, ["config_id"], top_k).withColumn("_own_top", F.lit(1))
    rows = (screens.join(stability, ["config_id", "feature"], "left").join(base, "feature", "left")
            .join(base_top, "feature", "left").join(own_top, ["config_id", "feature"], "left"))
    common = F.col("_common").isNotNull()
    same = F.coalesce(sign(F.col("coef")) == sign(F.col("_base")), F.lit(False)).cast("double")
    return rows.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("retained_features"),
        F.count_if(F.col("qvalue") < 0.10).alias("fdr_lt_0_10"),
        F.count_if(F.col("qvalue") < 0.05).alias("fdr_lt_0_05"),
        F.count_if(F.col("_base_top").isNotNull() & F.col("_own_top").isNotNull()).alias("top_overlap"),
        F.count_if(common).alias("common_features"),
        F.avg(F.when(common, same)).alias("direction_concordance"),
        F.count_if((F.col("qvalue") < 0.10) & (F.col("stability_fraction") >= 0.60)).alias("stable_candidates"))


def _grid(spark_df: DataFrame, structs: list) -> DataFrame:
    return spark_df.withColumn("_g", F.explode(F.array(*structs)))


def filter_features(landscape: DataFrame, prevalences: Sequence[float] = FILTER_PREVALENCE,
                    cohorts: Sequence[int] = FILTER_COHORTS) -> DataFrame:
    """(config_id, feature) for every pair of thresholds."""
    structs = [F.struct(F.lit(f"p{p:g}_c{c}").alias("config_id"), F.lit(float(p)).alias("p"), F.lit(int(c)).alias("c"))
               for p in prevalences for c in cohorts]
    return (_grid(landscape, structs)
            .filter((F.col("prevalence") >= F.col("_g.p")) & (F.col("cohorts_present") >= F.col("_g.c")))
            .select("_g.config_id", "feature"))


def feature_minimum(abundance: DataFrame) -> DataFrame:
    return abundance.filter("value > 0").groupBy("feature").agg(F.min("value").alias("smallest"))


def filter_sweep(samples: DataFrame, abundance: DataFrame, landscape: DataFrame, baseline: DataFrame,
                 gaps: DataFrame, prevalences: Sequence[float] = FILTER_PREVALENCE,
                 cohorts: Sequence[int] = FILTER_COHORTS) -> DataFrame:
    features = settle(filter_features(landscape, prevalences, cohorts))
    config = settle(features.join(feature_minimum(abundance), "feature").groupBy("config_id").agg(
        (F.min("smallest") / 2).alias("pseudocount")))
    screens = settle(config_screens(samples, abundance, features, config))
    return against_baseline(screens, baseline, gaps).join(config, "config_id").select(
        F.regexp_extract("config_id", "p([0-9.]+)_", 1).cast("double").alias("prevalence_threshold"),
        F.regexp_extract("config_id", "_c([0-9]+)", 1).cast("int").alias("min_cohorts_present"), "*").drop("config_id")


def pseudocount_sweep(samples: DataFrame, abundance: DataFrame, features: DataFrame, baseline: DataFrame,
                      gaps: DataFrame, multipliers: Sequence[float] = PSEUDOCOUNT_MULTIPLIERS) -> DataFrame:
    smallest = feature_minimum(keep_features(abundance, features)).agg(F.min("smallest").alias("smallest"))
    structs = [F.struct(F.lit(f"minimum_positive_x_{m:g}").alias("config_id"), F.lit(float(m)).alias("m"))
               for m in multipliers]
    config = settle(_grid(smallest, structs).select(
        "_g.config_id", (F.col("smallest") * F.col("_g.m")).alias("pseudocount")))
    own = _grid(features.select("feature"), structs).select("_g.config_id", "feature")
    screens = settle(config_screens(samples, abundance, own, config))
    return against_baseline(screens, baseline, gaps).join(config, "config_id").withColumnRenamed(
        "config_id", "pseudocount_rule")


def stability_threshold_sweep(stability: DataFrame) -> DataFrame:
    """Candidate counts by direction over the q and agreement thresholds."""
    structs = [F.struct(F.lit(q).alias("fdr_cutoff"), F.lit(t).alias("same_direction_threshold"))
               for q in FDR_CUTOFFS for t in STABILITY_THRESHOLDS]
    rows = _grid(stability, structs).select("*", "_g.*")
    hit = (F.col("qvalue") < F.col("fdr_cutoff")) & (F.col("stability_fraction") >= F.col("same_direction_threshold"))
    return rows.groupBy("fdr_cutoff", "same_direction_threshold").agg(
        F.count_if(hit).alias("candidate_count"),
        F.count_if(hit & (F.col("coef") > 0)).alias("case_higher"),
        F.count_if(hit & (F.col("coef") < 0)).alias("control_higher"))


def leave_one_out_rescreen(samples: DataFrame, abundance: DataFrame, features: DataFrame) -> DataFrame:
    """Leave-one-cohort-out screens with pseudocount and CLR redone per fold.

    Leaving a cohort out changes the pseudocount only if the smallest value lies
    in it, so the moments are needed for the distinct pseudocounts (two at most
    when the minimum is unique), not for every fold.
    """
    kept = keep_features(abundance, features)
    counts = settle(cohort_counts(samples))
    smallest = settle(kept.filter("value > 0").join(samples.select("sample_id", "cohort"), "sample_id")
                      .groupBy("cohort").agg(F.min("value").alias("smallest")))
    folds = settle(smallest.withColumn("design_id", F.explode(cohort_list(counts)))
                   .filter("design_id <> cohort").groupBy("design_id").agg((F.min("smallest") / 2).alias("pseudocount"))
                   .withColumn("config_id", F.col("pseudocount").cast("string")))
    config = folds.select("config_id", "pseudocount").distinct()
    configs = config.agg(F.collect_list("config_id")).scalar()
    own = features.select("feature").withColumn("config_id", F.explode(configs))
    moments = clr_moments(samples, kept, own, config=config)
    weights = design_weights(leave_one_out_designs(counts)).join(folds.select("design_id", "config_id"), "design_id")
    fitted = screen(moments, weights, ["config_id"]).drop("config_id")
    return bh_adjust(fitted, "pvalue", "qvalue", ["design_id"]).withColumnRenamed("design_id", "left_out")
