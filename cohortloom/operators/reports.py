"""Report tables and the data behind plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import species_tail
from ..functions.stats import neg_log10
from ..functions.text import (fixed, hyphenated, interval_text, median_iqr_text, multiplier_of, p_text, percent_text,
                              share_text, shortened, spaced, yes_no)
from .ranking import grouped_quantiles


def cohort_characteristics(samples: DataFrame, numeric: Sequence[str], counted: Sequence[str],
                           listed: Sequence[str]) -> DataFrame:
    """One row per cohort: class sizes, median (IQR) text, category counts, value lists."""
    out = samples.groupBy("cohort").agg(
        F.count_if(F.col("condition") == 1).alias("cases"), F.count_if(F.col("condition") == 0).alias("controls"),
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"{c}_non_missing") for c in numeric])
    for c in numeric:
        q = grouped_quantiles(samples, ["cohort"], c, [0.25, 0.5, 0.75])
        out = out.join(q.select("cohort", median_iqr_text(F.col("q0"), F.col("q1"), F.col("q2")).alias(f"{c}_median_iqr")),
                       "cohort", "left").withColumn(f"{c}_median_iqr", F.coalesce(f"{c}_median_iqr", F.lit("NA")))
    for c in counted:
        out = out.join(category_text(samples, c, True), "cohort", "left").withColumn(c, F.coalesce(c, F.lit("NA")))
    for c in listed:
        out = out.join(category_text(samples, c, False), "cohort", "left").withColumn(c, F.coalesce(c, F.lit("NA")))
    return out


def category_text(samples: DataFrame, column: str, with_counts: bool) -> DataFrame:
    """``key=count; ...`` or ``key; ...`` per cohort, keys sorted, empty text ignored.

    Counts are formed first, so a cohort brings together its distinct values only.
    """
    counts = (samples.select("cohort", F.col(column).cast("string").alias("_v")).filter("_v <> ''")
              .groupBy("cohort", "_v").agg(F.count(F.lit(1)).alias("_n")))
    item = F.format_string("%s=%d", "_v", "_n") if with_counts else F.col("_v")
    return counts.groupBy("cohort").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_v", item.alias("t")))), lambda s: s["t"]), "; ").alias(column))


def candidate_table(candidates: DataFrame) -> DataFrame:
    """Stable candidates as report text.

    Needs feature, direction, coef, se, pvalue, qvalue, prevalence_case,
    prevalence_control, cohorts_same_direction, cohorts_tested, other_qvalue,
    selected_fraction and score_rank.
    """
    low, high = F.col("coef") - 1.96 * F.col("se"), F.col("coef") + 1.96 * F.col("se")
    return candidates.select(
        spaced(species_tail(F.col("feature"))).alias("taxon"), hyphenated(F.col("direction")).alias("direction"),
        interval_text(F.col("coef"), low, high).alias("coefficient_ci"), p_text(F.col("pvalue")).alias("p_value"),
        p_text(F.col("qvalue")).alias("q_value"), percent_text(F.col("prevalence_case")).alias("case_prevalence"),
        percent_text(F.col("prevalence_control")).alias("control_prevalence"),
        share_text(F.col("cohorts_same_direction"), F.col("cohorts_tested")).alias("same_direction"),
        p_text(F.col("other_qvalue")).alias("covariate_q_value"),
        percent_text(F.col("selected_fraction"), 0).alias("selected_folds"), "score_rank")


def performance_table(folds: DataFrame, intervals: DataFrame) -> DataFrame:
    """Held-out results per cohort with the bootstrap interval as text."""
    joined = folds.join(intervals, "held_out", "left")
    return joined.select(
        "held_out", "n_train", "n_test", share_text(F.col("n_test_case"), F.col("n_test_control")).alias("classes_in_test"),
        interval_text(F.col("auroc"), F.col("ci_low"), F.col("ci_high")).alias("auroc_ci"),
        fixed(F.col("average_precision")).alias("average_precision"),
        F.coalesce("replicates_used", F.lit(0)).cast("bigint").alias("replicates_used"), "status")


def evidence_table(evidence: DataFrame, tested: DataFrame) -> DataFrame:
    """The evidence map as report text."""
    joined = evidence.join(tested.select("feature", "cohorts_tested"), "feature", "left")
    return joined.select(
        spaced(species_tail(F.col("feature"))).alias("taxon"), hyphenated(F.col("direction")).alias("direction"),
        percent_text(F.col("i2_percent") / 100, 1, "").alias("i2"),
        share_text(F.col("cohorts_same_direction"), F.col("cohorts_tested")).alias("same_direction"),
        fixed(F.col("same_direction_fraction")).alias("loco_direction_fraction"), fixed(F.col("fdr_fraction")).alias("loco_fdr_fraction"),
        yes_no(F.col("loco_robust")).alias("loco_robust"), yes_no(F.col("external_status")).alias("external_match"),
        yes_no(F.col("in_context_panel")).alias("in_context_panel"),
        F.when(F.col("interpretation_group") == "high_consistency_candidate", "yes").otherwise("no").alias("high_consistency"),
        spaced(F.col("interpretation_group")).alias("notes"))


def genus_table(panel: DataFrame, stable: DataFrame) -> DataFrame:
    """Per genus: its species as sorted text and whether a stable candidate belongs to it."""
    marked = panel.join(stable.select("feature", F.lit(1).alias("_s")), "feature", "left")
    species = marked.withColumn("_sp", species_tail(F.col("feature"))).groupBy("genus", "_sp").agg(F.max("_s").alias("_s"))
    return species.groupBy("genus").agg(
        F.array_join(F.array_sort(F.collect_list("_sp")), "; ").alias("species"),
        F.when(F.max("_s") == 1, "yes").otherwise("no").alias("among_stable"))


def combined_panels(folds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leave-one-out and pairwise summaries side by side."""
    left = folds.select("panel", "panel_size", *[F.col(c).alias(f"loso_{c}") for c in (
        "median_auroc", "minimum_auroc", "maximum_auroc", "auroc_iqr", "median_average_precision")])
    right = pairs.select("panel", "panel_size", F.col("within_cohort_median_auroc").alias("pairwise_within_median_auroc"),
                         "off_diagonal_median_auroc", "off_diagonal_auroc_iqr", "off_diagonal_minimum_auroc",
                         "off_diagonal_maximum_auroc", "transferability_loss", F.col("pairs").alias("off_diagonal_pairs"))
    return left.join(right, ["panel", "panel_size"], "left")


def random_type_summary(per_fold: DataFrame) -> DataFrame:
    """Medians over folds of the random-panel summary, per random type and observed panel."""
    return per_fold.groupBy("panel", "observed").agg(
        F.countDistinct("held_out").alias("held_out_cohorts"), F.median("median_auroc").alias("median_random_auroc"),
        F.median("observed_auroc").alias("median_observed_auroc"), F.median("empirical_p").alias("median_empirical_p"))


def volcano(association: DataFrame) -> DataFrame:
    return association.select(
        "feature", "coef", neg_log10(F.col("qvalue")).alias("neglog10_q"),
        F.when(F.col("qvalue") < 0.10, "FDR<0.10").otherwise("not significant").alias("label"))


def forest(association: DataFrame, k: int = 14) -> DataFrame:
    """The leading features with 95 percent intervals and a short label."""
    top = association.orderBy(F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "feature").limit(k)
    return top.select("feature", shortened(species_tail(F.col("feature")), 32).alias("label"), "coef",
                      (F.col("coef") - 1.96 * F.col("se")).alias("ci_low"), (F.col("coef") + 1.96 * F.col("se")).alias("ci_high"))


def histogram(df: DataFrame, value: str, bins: int = 24) -> DataFrame:
    """Counts in equal bins between minimum and maximum; the maximum belongs to the last."""
    edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    rows = df.filter(F.col(value).isNotNull()).withColumn("_e", edges)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_e.lo")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins))).otherwise(1)
    return rows.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    spread = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return grouped_quantiles(df, keys, value, [0.25, 0.5, 0.75]).withColumnsRenamed(
        {"q0": "first_quartile", "q1": "median", "q2": "third_quartile"}).join(spread, list(keys))


def per_train_cohort(pairs: DataFrame) -> DataFrame:
    """Off-diagonal median and range of the AUROC per training cohort."""
    return pairs.filter("NOT is_diagonal").groupBy("train_cohort").agg(
        F.median("auroc").alias("median"), F.min("auroc").alias("low"), F.max("auroc").alias("high"))


def effect_heatmap(effects: DataFrame, leading: DataFrame, cohorts: Sequence[str]) -> DataFrame:
    """Feature x cohort mean effect of chosen features."""
    return (effects.join(leading.select("feature"), "feature", "left_semi").groupBy("feature")
            .pivot("cohort", list(cohorts)).agg(F.avg("effect")))


def support_matrix(evidence: DataFrame) -> DataFrame:
    """Evidence layers as 0/1 columns."""
    layers = ("covariate_supported", "meta_supported", "loco_robust", "model_supported", "in_context_panel")
    return evidence.select("feature", *[F.col(c).cast("int").alias(c) for c in layers],
                           (F.col("external_status") == "GENUS_MATCH").cast("int").alias("external_match"))


def filter_lines(sweep: DataFrame, cohorts: int = 3) -> DataFrame:
    return sweep.filter(F.col("min_cohorts_present") == cohorts).select(
        (F.col("prevalence_threshold") * 100).alias("prevalence_percent"), "retained_features", "fdr_lt_0_10",
        "stable_candidates")


def pseudocount_lines(sweep: DataFrame) -> DataFrame:
    return sweep.select(multiplier_of(F.col("pseudocount_rule")).alias("multiplier"), "direction_concordance", "top_overlap")


def overlap_bars(overlap: DataFrame, order: Sequence[str]) -> DataFrame:
    """Median overlap per panel and reference panel with the panel's place in the order."""
    place: Column = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("panel"))
    return overlap.groupBy("panel", "reference").agg(F.median("overlap").alias("median_overlap")).withColumn(
        "place", place).filter("place > 0")


def member_counts(members: DataFrame) -> DataFrame:
    """Members and stable members per guild."""
    return members.groupBy("guild").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("stable") == "yes").alias("stable_members"))
