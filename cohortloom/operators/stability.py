"""Direction agreement of a feature across cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, sign
from .composition import keep_features
from .ranking import grouped_quantiles, mann_whitney


def with_zero_counts(samples: DataFrame, abundance: DataFrame, features: DataFrame,
                     by: Sequence[str]) -> DataFrame:
    """(feature, *by, value, weight): values with repeat counts, zeros as one row.

    The implicit zeros of a group are its sample count less its non-zero rows.
    """
    by = list(by)
    present = (keep_features(abundance, features).filter("value > 0")
               .join(samples.select("sample_id", *by), "sample_id"))
    positives = present.select("feature", *by, "value", F.lit(1).cast("bigint").alias("weight"))
    cells = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.collect_list(F.struct(*by, "_n"))).scalar()
    seen = present.groupBy("feature", *by).agg(F.count(F.lit(1)).alias("_seen"))
    zeros = (features.select("feature", F.explode(cells).alias("_c")).select("feature", "_c.*")
             .join(seen, ["feature", *by], "left")
             .select("feature", *by, F.lit(0.0).alias("value"),
                     (F.col("_n") - F.coalesce("_seen", F.lit(0))).alias("weight")))
    return positives.unionByName(zeros.filter("weight > 0"))


def condition_medians(samples: DataFrame, abundance: DataFrame, features: DataFrame) -> DataFrame:
    """Prevalence and median abundance by condition, and the median difference."""
    rows = with_zero_counts(samples, abundance, features, ["condition"])
    medians = grouped_quantiles(rows, ["feature", "condition"], "value", [0.5], "weight")
    shares = rows.groupBy("feature", "condition").agg(
        (F.sum(F.when(F.col("value") > 0, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("prevalence"),
        F.sum("weight").alias("n"))
    both = medians.join(shares, ["feature", "condition"])

    def pick(column: str, condition: int) -> Column:
        return F.max(F.when(F.col("condition") == condition, F.col(column)))

    return both.groupBy("feature").agg(
        pick("n", 1).alias("n_case"), pick("n", 0).alias("n_control"),
        pick("prevalence", 1).alias("prevalence_case"), pick("prevalence", 0).alias("prevalence_control"),
        pick("q0", 1).alias("median_case"), pick("q0", 0).alias("median_control"),
        (pick("q0", 1) - pick("q0", 0)).alias("median_diff"))


def mann_whitney_screen(samples: DataFrame, abundance: DataFrame, features: DataFrame) -> DataFrame:
    """Rank test on raw abundance per feature, implicit zeros included."""
    rows = with_zero_counts(samples, abundance, features, ["condition"])
    counts = rows.select(
        "feature", "value",
        F.when(F.col("condition") == 1, F.col("weight")).otherwise(0).alias("case"),
        F.when(F.col("condition") == 0, F.col("weight")).otherwise(0).alias("control"))
    return mann_whitney(counts, ["feature"], "value", "case", "control")


def cohort_median_gaps(samples: DataFrame, abundance: DataFrame, features: DataFrame) -> DataFrame:
    """Median case minus median control abundance per (feature, cohort with both classes)."""
    rows = with_zero_counts(samples, abundance, features, ["cohort", "condition"])
    medians = grouped_quantiles(rows, ["feature", "cohort", "condition"], "value", [0.5], "weight")
    gaps = medians.groupBy("feature", "cohort").agg(
        F.max(F.when(F.col("condition") == 1, F.col("q0"))).alias("_case"),
        F.max(F.when(F.col("condition") == 0, F.col("q0"))).alias("_control"))
    return gaps.select("feature", "cohort", (F.col("_case") - F.col("_control")).alias("median_diff")).filter(
        "median_diff IS NOT NULL")


def median_stability(gaps: DataFrame, coefficients: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of tested cohorts whose median difference has the sign of the pooled
    coefficient.  A zero difference is tested and does not agree."""
    joined = coefficients.select(*keys, "feature", "coef").join(gaps, "feature", "left")
    agrees = F.coalesce((sign(F.col("coef")) != 0) & (sign(F.col("median_diff")) == sign(F.col("coef"))), F.lit(False))
    text = F.concat_ws(":", "cohort", F.format_string("%.6f", F.col("median_diff") + F.lit(0.0)))
    out = joined.groupBy(*keys, "feature").agg(
        F.count("median_diff").alias("cohorts_tested"),
        F.count_if(agrees).alias("cohorts_same_direction"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("median_diff").isNotNull(), F.struct("cohort", text.alias("t"))))),
            lambda s: s["t"]), ";").alias("detail"))
    return out.withColumn("stability_fraction", ratio(
        F.col("cohorts_same_direction").cast("double"), F.col("cohorts_tested").cast("double")))


def mean_direction_support(moments: DataFrame, designs: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Share of the design's cohorts whose CLR mean difference has the sign of the
    design's coefficient; zero differences do not count at all."""
    rows = (moments.filter("n1 > 0 AND n0 > 0").join(designs.select("design_id", "cohort"), "cohort")
            .join(coefficients.select("design_id", "feature", "coef"), ["design_id", "feature"]))
    gap = sign(F.col("mean1") - F.col("mean0"))
    counted = (gap != 0) & (sign(F.col("coef")) != 0)
    out = rows.groupBy("design_id", "feature").agg(
        F.count_if(counted).alias("eligible_cohorts"),
        F.count_if(counted & (gap == sign(F.col("coef")))).alias("same_direction_cohorts"))
    return out.withColumn("same_direction_fraction", ratio(
        F.col("same_direction_cohorts").cast("double"), F.col("eligible_cohorts").cast("double")))


def stable_candidates(stability: DataFrame, q: float = 0.10, fraction: float = 0.60) -> DataFrame:
    return stability.filter((F.col("qvalue") < q) & (F.col("stability_fraction") >= fraction))


def leave_one_out_summary(fits: DataFrame) -> DataFrame:
    """Roll-up of flagged leave-one-out fits per feature with the robustness rule
    (same direction in at least 90 percent, q < 0.10 in at least 80 percent)."""
    out = fits.groupBy("feature").agg(
        F.count(F.lit(1)).alias("models"),
        F.count_if("same_direction").alias("same_direction_models"),
        F.avg(F.col("same_direction").cast("double")).alias("same_direction_fraction"),
        F.count_if("fdr_hit").alias("fdr_models"),
        F.avg(F.col("fdr_hit").cast("double")).alias("fdr_fraction"),
        F.min("qvalue").alias("min_qvalue"), F.max("qvalue").alias("max_qvalue"))
    return out.withColumn("robust", (F.col("same_direction_fraction") >= 0.90) & (F.col("fdr_fraction") >= 0.80))


def flag_against_baseline(fits: DataFrame, baseline: DataFrame, q: float = 0.10) -> DataFrame:
    """Direction and FDR flags of every fit against the pooled coefficient."""
    base = baseline.select("feature", F.col("coef").alias("_base"))
    return (fits.join(base, "feature")
            .withColumn("same_direction", F.coalesce(sign(F.col("coef")) == sign(F.col("_base")), F.lit(False)))
            .withColumn("fdr_hit", F.coalesce(F.col("qvalue") < q, F.lit(False))).drop("_base"))
