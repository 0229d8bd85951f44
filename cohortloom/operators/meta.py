"""Per-cohort effects and DerSimonian-Laird random effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_upper_tail, direction, normal_two_sided, ratio, sign
from ..session import settle
from .ranking import bh_adjust


def _sample_variance(g: int) -> Column:
    n = F.col(f"n{g}").cast("double")
    return F.col(f"var{g}") * ratio(n, n - 1)


def welch_effects(moments: DataFrame, min_n: int = 2) -> DataFrame:
    """Case minus control mean per (feature, cohort) with unequal-variance error."""
    enough = (F.col("n1") >= min_n) & (F.col("n0") >= min_n)
    variance = _sample_variance(1) / F.col("n1") + _sample_variance(0) / F.col("n0")
    out = (moments
           .withColumn("effect", F.when(enough, F.col("mean1") - F.col("mean0")))
           .withColumn("_v", F.when(enough, variance))
           .withColumn("se", F.when(F.col("_v") > 0, F.sqrt("_v")))
           .withColumn("z_value", F.col("effect") / F.col("se"))
           .withColumn("pvalue", normal_two_sided("z_value")))
    status = (F.when(~enough, "INSUFFICIENT_GROUP_SIZE")
              .when(F.col("z_value").isNull(), "ZERO_OR_UNESTIMABLE_VARIANCE").otherwise("COMPUTED"))
    return out.select("feature", "cohort", F.col("n1").alias("n_case"), F.col("n0").alias("n_control"),
                      "effect", "se", "z_value", "pvalue", status.alias("status"))


def hedges_effects(moments: DataFrame, min_n: int = 2) -> DataFrame:
    """Standardised mean difference with the small-sample correction."""
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    total = n1 + n0
    enough = (F.col("n1") >= min_n) & (F.col("n0") >= min_n)
    pooled = F.sqrt(ratio((n1 - 1) * _sample_variance(1) + (n0 - 1) * _sample_variance(0), total - 2))
    g = ratio(F.col("mean1") - F.col("mean0"), pooled) * (1 - ratio(F.lit(3.0), 4 * total - 9))
    out = moments.withColumn("effect", F.when(enough, g))
    se = F.sqrt(ratio(total, n1 * n0) + F.col("effect") * F.col("effect") / F.nullif(2 * (total - 2), F.lit(0.0)))
    return (out.withColumn("se", F.when(F.col("effect").isNotNull(), se))
            .withColumn("_z", ratio(F.col("effect"), F.col("se")))
            .withColumn("pvalue", normal_two_sided("_z"))
            .select("feature", "cohort", F.col("n1").alias("n_case"), F.col("n0").alias("n_control"),
                    "mean1", "mean0", "effect", "se", "pvalue"))


def random_effects(effects: DataFrame, keys: Sequence[str], min_k: int = 2,
                   effect: str = "effect", se: str = "se") -> DataFrame:
    """DerSimonian-Laird pooling per key in two groupings.

    Every key of the input is kept; with fewer than ``min_k`` usable cohorts the
    estimates are NULL and ``k_cohorts`` still counts what there was.
    """
    keys = list(keys)
    usable = F.col(effect).isNotNull() & (F.col(se) > 0)
    base = (effects.withColumn("_y", F.when(usable, F.col(effect)))
            .withColumn("_v", F.when(usable, F.col(se) * F.col(se)))
            .withColumn("_w", 1 / F.col("_v")))
    first = base.groupBy(*keys).agg(
        F.count("_y").alias("k_cohorts"), F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_w")).alias("_sww"), F.sum(F.col("_w") * F.col("_y")).alias("_swy"))
    centre = (first.withColumn("fixed_effect", F.when(F.col("k_cohorts") >= min_k, F.col("_swy") / F.col("_sw")))
              .withColumn("_c", F.col("_sw") - F.col("_sww") / F.col("_sw")).select(*keys, "k_cohorts", "fixed_effect", "_c"))
    q_rows = base.select(*keys, "_y", "_v", "_w").join(centre.select(*keys, "fixed_effect"), keys)
    gap = F.col("_y") - F.col("fixed_effect")
    heterogeneity = q_rows.groupBy(*keys).agg(F.sum(F.col("_w") * gap * gap).alias("q_statistic"))
    spread = (centre.join(heterogeneity, keys)
              .withColumn("q_df", F.when(F.col("k_cohorts") >= min_k, F.col("k_cohorts") - 1))
              .withColumn("tau2", F.when(F.col("q_df").isNotNull(), F.when(
                  F.col("_c") > 0, F.greatest(F.lit(0.0), (F.col("q_statistic") - F.col("q_df")) / F.col("_c")))
                  .otherwise(0.0))))
    final = (base.select(*keys, "_y", "_v").join(spread.select(*keys, "tau2"), keys)
             .withColumn("_wr", 1 / (F.col("_v") + F.col("tau2")))
             .groupBy(*keys).agg(F.sum("_wr").alias("_swr"), F.sum(F.col("_wr") * F.col("_y")).alias("_swry")))
    q = F.col("q_statistic")
    return (spread.join(final, keys)
            .withColumn("random_effect", F.col("_swry") / F.col("_swr"))
            .withColumn("random_se", F.sqrt(1 / F.col("_swr")))
            .withColumn("z_value", ratio(F.col("random_effect"), F.col("random_se")))
            .withColumn("pvalue", normal_two_sided("z_value"))
            .withColumn("q_pvalue", chi2_upper_tail("q_statistic", "q_df"))
            .select(*keys, "k_cohorts", "fixed_effect", "random_effect", "random_se",
                    (F.col("random_effect") - 1.96 * F.col("random_se")).alias("random_ci_low"),
                    (F.col("random_effect") + 1.96 * F.col("random_se")).alias("random_ci_high"),
                    "z_value", "pvalue", "q_statistic", "q_df", "q_pvalue", "tau2",
                    F.when(F.col("q_df").isNotNull(), F.when(
                        q > 0, F.greatest(F.lit(0.0), (q - F.col("q_df")) / F.nullif(q, F.lit(0.0))) * 100)
                        .otherwise(0.0)).alias("i2_percent")))


def meta_table(welch: DataFrame) -> DataFrame:
    """Random effects per feature with direction counts and q values.

    All cohort rows of a feature are listed even where nothing was computed.
    """
    rows = settle(welch)
    computed = rows.withColumn("effect", F.when(F.col("status") == "COMPUTED", F.col("effect")))
    pooled = random_effects(computed, ["feature"], min_k=3)
    counts = (computed.join(pooled.select("feature", "random_effect"), "feature").groupBy("feature").agg(
        F.count_if(F.col("effect") > 0).alias("cohorts_positive"),
        F.count_if(F.col("effect") < 0).alias("cohorts_negative"),
        F.count_if((F.col("random_effect") != 0) & (sign(F.col("effect")) == sign(F.col("random_effect"))))
        .alias("cohorts_same_direction")))
    joined = pooled.join(counts, "feature").withColumn(
        "same_direction_fraction", ratio(F.col("cohorts_same_direction").cast("double"), F.col("k_cohorts").cast("double")))
    return bh_adjust(joined, "pvalue", "qvalue").withColumn("direction", direction(F.col("random_effect")))


def metric_meta(moments: DataFrame, min_n: int = 3) -> DataFrame:
    """Hedges g per cohort and metric, pooled per metric, q over metrics."""
    pooled = random_effects(settle(hedges_effects(moments, min_n)), ["feature"], min_k=2)
    return bh_adjust(pooled, "pvalue", "qvalue").withColumnRenamed("feature", "metric")
