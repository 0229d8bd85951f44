"""Joins of result tables into scores, candidates and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.lineage import genus
from ..functions.stats import neg_log10, sign
from .ranking import ranked_with_ties


def compare_screens(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """Baseline features with the other screen's result, signs and concordance.

    A missing sign is never concordant.
    """
    right = other.select("feature", F.col("coef").alias("other_coef"), F.col("pvalue").alias("other_pvalue"),
                         F.col("qvalue").alias("other_qvalue"))
    return (baseline.select("feature", "coef", "pvalue", "qvalue").join(right, "feature", "left")
            .withColumn("baseline_sign", sign(F.col("coef"))).withColumn("other_sign", sign(F.col("other_coef")))
            .withColumn("direction_concordant",
                        F.coalesce(F.col("baseline_sign") == F.col("other_sign"), F.lit(False))))


def leading(fits: DataFrame, k: int) -> DataFrame:
    return fits.orderBy(F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "feature").limit(k)


def comparison_summary(compared: DataFrame, baseline: DataFrame, other: DataFrame, stable: DataFrame,
                       k: int = 100, q: float = 0.10) -> DataFrame:
    """Preserved counts, top-k overlap and the concordance rate, one row."""
    rows = compared.join(stable.select("feature", F.lit(True).alias("_stable")), "feature", "left")
    overlap = leading(baseline, k).select("feature").join(leading(other, k).select("feature"), "feature", "left_semi")
    kept = (F.col("other_qvalue") < q) & F.col("direction_concordant")
    both = F.col("baseline_sign").isNotNull() & F.col("other_sign").isNotNull()
    return rows.agg(
        F.count_if(F.col("qvalue") < q).alias("baseline_fdr"), F.count_if(F.col("other_qvalue") < q).alias("other_fdr"),
        F.count_if((F.col("qvalue") < q) & kept).alias("baseline_preserved"),
        F.count_if(F.col("_stable") & kept).alias("stable_preserved"),
        F.avg(F.when(both, F.col("direction_concordant").cast("double"))).alias("concordance_rate")).withColumn(
        "top_overlap", overlap.agg(F.count(F.lit(1))).scalar())


def external_overlap(association: DataFrame, stability: DataFrame, external: DataFrame, k: int = 100,
                     match_empty_genus: bool = False) -> DataFrame:
    """The leading features with every external row of their genus.

    ``external`` has a ``feature`` lineage and effect columns; matches fan out.
    By default an empty genus matches nothing.
    """
    order = Window.partitionBy("_k").orderBy(
        F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), "feature")
    top = (association.withColumn("_k", F.lit(0)).withColumn("rank", F.row_number().over(order))
           .filter(F.col("rank") <= k).drop("_k").withColumn("genus", genus(F.col("feature")))
           .join(stability.select("feature", "stability_fraction"), "feature", "left"))
    other = external.withColumnRenamed("feature", "external_feature").withColumn(
        "_genus", genus(F.col("external_feature")))
    if not match_empty_genus:
        other = other.filter(F.col("_genus") != "")
    return (top.join(other, top["genus"].eqNullSafe(other["_genus"]), "left").drop("_genus")
            .withColumn("match_status", F.when(F.col("external_feature").isNotNull(), "GENUS_MATCH")
                        .otherwise("NO_GENUS_MATCH")))


def prefixed_columns(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def composite_score(association: DataFrame, stability: DataFrame, compared: DataFrame, weights: DataFrame,
                    seed: int = 0) -> DataFrame:
    """-log10(q) * stability * (1 or 1/2 by covariate support) * (1 + mean |weight|).

    Missing parts count as zero; the rank breaks ties by a keyed draw.
    """
    joined = (association.select("feature", "coef", "qvalue")
              .join(stability.select("feature", "stability_fraction"), "feature", "left")
              .join(compared.select("feature", "other_qvalue", "direction_concordant"), "feature", "left")
              .join(weights.select("feature", "mean_abs_weight", "selected_fraction"), "feature", "left"))
    supported = F.coalesce((F.col("other_qvalue") < 0.10) & F.col("direction_concordant"), F.lit(False))
    scored = (joined.withColumn("neglog10_q", neg_log10(F.col("qvalue")))
              .withColumn("covariate_supported", supported)
              .withColumn("score", F.coalesce("neglog10_q", F.lit(0.0)) * F.coalesce("stability_fraction", F.lit(0.0))
                          * F.when(supported, 1.0).otherwise(0.5) * (1 + F.coalesce("mean_abs_weight", F.lit(0.0))))
              .withColumn("_tie", draw(seed, "composite", F.col("feature"))))
    return ranked_with_ties(scored, "score", "_tie", "score_rank").drop("_tie")


def meta_candidates(meta: DataFrame, association: DataFrame, stability: DataFrame, compared: DataFrame,
                    scores: DataFrame) -> DataFrame:
    """Random effects joined with the other evidence; the candidate rule is
    q < 0.10, at least 60 percent same direction and I2 below 75."""
    joined = (meta.select("feature", "k_cohorts", "random_effect", "random_se",
                          F.col("qvalue").alias("meta_qvalue"), "same_direction_fraction", "i2_percent")
              .join(association.select("feature", "coef", "qvalue", "direction"), "feature", "left")
              .join(stability.select("feature", "stability_fraction"), "feature", "left")
              .join(compared.select("feature", "other_qvalue", "direction_concordant"), "feature", "left")
              .join(scores.select("feature", "score", "score_rank"), "feature", "left"))
    rule = (F.col("meta_qvalue") < 0.10) & (F.col("same_direction_fraction") >= 0.60) & (F.col("i2_percent") < 75)
    return (joined.withColumn("meta_stable_candidate", F.coalesce(rule, F.lit(False)))
            .withColumn("pooled_direction_concordant",
                        F.coalesce(sign(F.col("random_effect")) == sign(F.col("coef")), F.lit(False))))


def meta_summary(candidates: DataFrame, median_i2: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("features_tested"), F.count_if(F.col("meta_qvalue") < 0.10).alias("meta_fdr_lt_0_10"),
        F.count_if("meta_stable_candidate").alias("meta_stable_candidates"),
        F.count_if(F.col("i2_percent") >= 75).alias("high_heterogeneity")).withColumn(
        "median_i2_percent", median_i2.scalar())


def evidence_map(stable: DataFrame, compared: DataFrame, scores: DataFrame, meta: DataFrame, context: DataFrame,
                 external_status: DataFrame, rescreen: DataFrame) -> DataFrame:
    """Five evidence layers per stable candidate, their count and the class.

    The first matching class wins: high consistency, heterogeneous, context, bounded.
    """
    status = external_status.groupBy("feature").agg(F.max("match_status").alias("external_status"))
    joined = (stable.select("feature", "coef", "qvalue", "stability_fraction", "cohorts_same_direction")
              .join(compared.select("feature", "other_qvalue", "direction_concordant"), "feature", "left")
              .join(scores.select("feature", "score_rank", "selected_fraction"), "feature", "left")
              .join(meta.select("feature", "random_effect", F.col("qvalue").alias("meta_qvalue"), "i2_percent"),
                    "feature", "left")
              .join(rescreen.select("feature", "same_direction_fraction", "fdr_fraction", "robust"), "feature", "left")
              .join(context.select("feature", F.lit(True).alias("_context")).distinct(), "feature", "left")
              .join(status, "feature", "left"))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    out = (joined
           .withColumn("direction", F.when(F.col("coef") > 0, "CRC_higher").otherwise("control_higher"))
           .withColumn("external_status", F.coalesce("external_status", F.lit("NOT_IN_TOP100_CONTEXT")))
           .withColumn("covariate_supported", flag(F.col("other_qvalue") < 0.10))
           .withColumn("meta_supported", flag(F.col("meta_qvalue") < 0.10))
           .withColumn("model_supported", flag(F.col("selected_fraction") >= 0.50))
           .withColumn("loco_robust", flag(F.col("robust")))
           .withColumn("in_context_panel", flag(F.col("_context")))
           .withColumn("high_heterogeneity", flag(F.col("i2_percent") >= 75)))
    layers: Sequence[str] = ("covariate_supported", "meta_supported", "model_supported", "loco_robust", "in_context_panel")
    count = F.lit(0)
    for layer in layers:
        count = count + F.col(layer).cast("int")
    group = (F.when(F.col("loco_robust") & F.col("meta_supported") & ~F.col("high_heterogeneity"),
                    "high_consistency_candidate")
             .when(F.col("high_heterogeneity"), "heterogeneous_candidate")
             .when(F.col("in_context_panel") & (F.col("direction") == "CRC_higher"), "oral_associated_context_candidate")
             .otherwise("bounded_candidate"))
    return (out.withColumn("support_layers", count).withColumn("interpretation_group", group)
            .drop("_context", "robust"))


def fill_ledger(claims: DataFrame, values: DataFrame, default: str = "UNAVAILABLE: claim not executed") -> DataFrame:
    """Claims with their computed value; the last value of a repeated key wins."""
    latest = values.groupBy("claim_id").agg(F.max_by("value", "position").alias("actual_value"))
    filled = claims.join(latest, "claim_id", "left").withColumn("actual_value", F.coalesce("actual_value", F.lit(default)))
    return filled.withColumn("evidence_class", F.when(
        F.startswith("actual_value", F.lit("UNAVAILABLE")), "limitation").otherwise("computed_result"))


def metric_ledger(one_row: DataFrame) -> DataFrame:
    """A one-row table of scalars as (metric, value) text."""
    texts = one_row.select(*[F.col(c).cast("string").alias(c) for c in one_row.columns])
    return texts.unpivot([], list(texts.columns), "metric", "value")
