"""Feature sets by lineage rules, their sample scores and score screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import mapped_rank
from ..functions.stats import direction
from ..session import settle
from .composition import keep_features, pseudocount, sample_centres, shifted_logs
from .moments import (cohort_counts, design_weights, leave_one_out_designs, pooled_design, score_moments, screen,
                      single_cohort_screen)
from .ranking import bh_adjust, class_rank_metrics
from .stability import flag_against_baseline

# The prior genus panel.
PRIOR_GENERA = (
    "Actinomyces", "Atopobium", "Campylobacter", "Dialister", "Fusobacterium", "Gemella", "Granulicatella",
    "Leptotrichia", "Parvimonas", "Peptostreptococcus", "Porphyromonas", "Prevotella", "Selenomonas",
    "Solobacterium", "Streptococcus", "Treponema", "Veillonella")

# Guild rules (guild, rank, name), first version.
GUILD_RULES_V1 = (
    *[("butyrate_scfa_commensal", "s", name) for name in (
        "Faecalibacterium prausnitzii", "Roseburia faecis", "Roseburia hominis", "Roseburia intestinalis",
        "Roseburia inulinivorans", "Anaerostipes hadrus", "Agathobaculum butyriciproducens",
        "Butyricicoccus pullicaecorum", "Butyricimonas virosa", "Butyricimonas synergistica",
        "Eubacterium eligens", "Eubacterium hallii", "Eubacterium rectale", "Fusicatenibacter saccharivorans",
        "Intestinimonas butyriciproducens", "Gemmiger formicilis", "Ruminococcus bromii", "Ruminococcus lactaris")],
    ("butyrate_scfa_commensal", "g", "Roseburia"),
    *[("oral_pathobiont_associated", "g", name) for name in PRIOR_GENERA],
    ("bacteroides_enterobacteriaceae_context", "g", "Bacteroides"),
    ("bacteroides_enterobacteriaceae_context", "f", "Enterobacteriaceae"))

# Guild rules (guild, rank, name), second version.
GUILD_RULES_V2 = (
    *[("butyrate_SCFA_commensal_panel", "g", name) for name in (
        "Roseburia", "Faecalibacterium", "Eubacterium", "Anaerostipes", "Fusicatenibacter", "Agathobaculum",
        "Gemmiger", "Intestinimonas")],
    *[("oral_pathobiont_associated_panel", "g", name) for name in (
        "Parvimonas", "Peptostreptococcus", "Fusobacterium", "Gemella", "Streptococcus", "Solobacterium")],
    ("inflammation_Bacteroides_Enterobacteriaceae_panel", "s", "Bacteroides fragilis"),
    ("inflammation_Bacteroides_Enterobacteriaceae_panel", "s", "Escherichia coli"),
    ("inflammation_Bacteroides_Enterobacteriaceae_panel", "g", "Bilophila"),
    ("inflammation_Bacteroides_Enterobacteriaceae_panel", "f", "Enterobacteriaceae"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "guild string, rank string, name string")


def guild_membership(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (guild, feature) whose family, genus or species matches a rule.

    ``small`` marks guilds with fewer than three members.
    """
    ranks = [F.struct(F.lit(k).alias("rank"), mapped_rank(F.col("feature"), k, k == "s").alias("name"))
             for k in ("f", "g", "s")]
    members = (features.select("feature", F.explode(F.array(*ranks)).alias("_r"))
               .select("feature", "_r.*").join(rules, ["rank", "name"]).select("guild", "feature").distinct())
    sizes = members.groupBy("guild").agg(F.count(F.lit(1)).alias("n_features"))
    return members.join(sizes, "guild").select(
        "guild", "feature", mapped_rank(F.col("feature"), "g").alias("genus"),
        mapped_rank(F.col("feature"), "s", True).alias("species"), "n_features", (F.col("n_features") < 3).alias("small"))


def describe_members(members: DataFrame, association: DataFrame, stable: DataFrame) -> DataFrame:
    """Membership with the screen's direction and whether the feature is stable."""
    return (members.join(association.select("feature", "direction"), "feature", "left")
            .join(stable.select("feature", F.lit("yes").alias("_s")), "feature", "left")
            .withColumn("direction", F.coalesce("direction", F.lit("")))
            .withColumn("stable", F.coalesce("_s", F.lit("no"))).drop("_s"))


def guild_scores(samples: DataFrame, abundance: DataFrame, features: DataFrame, members: DataFrame,
                 min_members: int = 2) -> DataFrame:
    """Mean CLR of the members per (sample, guild): sum(u)/k - s over non-zero rows."""
    kept = keep_features(abundance, features)
    logs = shifted_logs(kept, pseudocount(kept).scalar())
    centres = sample_centres(samples, logs, features.agg(F.count(F.lit(1))).scalar())
    used = members.filter(F.col("n_features") >= min_members)
    sums = logs.join(used.select("guild", "feature"), "feature").groupBy("sample_id", "guild").agg(F.sum("u").alias("_u"))
    guilds = used.groupBy("guild").agg(F.max("n_features").alias("n_features")).agg(
        F.collect_list(F.struct("guild", "n_features"))).scalar()
    return (centres.withColumn("_g", F.explode(guilds)).select("*", "_g.*").drop("_g")
            .join(sums, ["sample_id", "guild"], "left")
            .withColumn("score", F.coalesce("_u", F.lit(0.0)) / F.col("n_features") - F.col("s"))
            .select("sample_id", "cohort", "condition", "guild", "n_features", "score"))


def as_feature(scores: DataFrame) -> DataFrame:
    return scores.select("sample_id", F.col("guild").alias("feature"), "score")


class GuildScreens:
    """Score screens of a set of guilds on one table of cohort moments."""

    def __init__(self, samples: DataFrame, scores: DataFrame):
        self.scores = settle(scores)
        self.counts = settle(cohort_counts(samples))
        self.moments = settle(score_moments(samples, as_feature(self.scores)))

    def association(self) -> DataFrame:
        """Cohort-adjusted coefficient with 95 percent interval and q over guilds."""
        fitted = screen(self.moments, design_weights(pooled_design(self.counts))).drop("design_id")
        return (bh_adjust(fitted, "pvalue", "qvalue").withColumnRenamed("feature", "guild")
                .withColumn("ci_low", F.col("coef") - 1.96 * F.col("se"))
                .withColumn("ci_high", F.col("coef") + 1.96 * F.col("se"))
                .withColumn("direction", direction(F.col("coef"), "control_higher")))

    def per_cohort(self) -> DataFrame:
        return single_cohort_screen(self.moments, self.counts).withColumnRenamed("feature", "guild")

    def leave_one_out(self) -> DataFrame:
        """Every exclusion's fit, q over the guilds of an exclusion."""
        fitted = screen(self.moments, design_weights(leave_one_out_designs(self.counts)))
        return bh_adjust(fitted, "pvalue", "qvalue", ["design_id"]).select(
            F.col("feature").alias("guild"), F.col("design_id").alias("left_out"), "n1", "n0", "coef", "se", "pvalue",
            "qvalue", direction(F.col("coef"), "control_higher").alias("direction"))

    def leave_one_out_flags(self) -> DataFrame:
        base = self.association().withColumnRenamed("guild", "feature")
        return flag_against_baseline(self.leave_one_out().withColumnRenamed("guild", "feature"), base)

    def oriented(self, association: DataFrame) -> DataFrame:
        """Scores turned so that higher values point to cases (zero counts as up)."""
        turn = association.select("guild", F.when(F.col("coef") >= 0, 1).otherwise(-1).alias("_turn"))
        return self.scores.join(turn, "guild").withColumn("oriented_score", F.col("score") * F.col("_turn")).drop("_turn")

    def score_only_transfer(self, leave_one_out: DataFrame) -> DataFrame:
        """AUROC and average precision of the score in the cohort left out,
        oriented by the sign of the coefficient in the training cohorts."""
        turn = leave_one_out.select(
            "guild", F.col("left_out").alias("cohort"), F.when(F.col("coef") >= 0, 1).otherwise(-1).alias("_turn"))
        rows = settle(self.scores.join(turn, ["guild", "cohort"]).withColumn("_oriented", F.col("score") * F.col("_turn")))
        facts = rows.groupBy("guild", "cohort").agg(F.max("n_features").alias("n_features"), F.max("_turn").alias("_turn"))
        return class_rank_metrics(rows, ["guild", "cohort"], "_oriented", "condition").join(facts, ["guild", "cohort"]).select(
            "guild", F.col("cohort").alias("held_out"), "n_features",
            F.when(F.col("_turn") > 0, "CRC_higher").otherwise("control_higher").alias("training_orientation"),
            "auroc", "average_precision", (F.col("n_pos") + F.col("n_neg")).alias("n_test"),
            F.format_string("CRC=%d;control=%d", "n_pos", "n_neg").alias("classes_in_test"))


def prior_panel(samples: DataFrame, abundance: DataFrame, features: DataFrame, genera: DataFrame) -> DataFrame:
    """Features of a genus list with prevalence and mean abundance over all samples."""
    n = samples.agg(F.count(F.lit(1))).scalar()
    named = features.select("feature", mapped_rank(F.col("feature"), "g").alias("genus"))
    members = named.join(genera.select("genus").distinct(), "genus", "left_semi")
    stats = abundance.join(members.select("feature"), "feature", "left_semi").groupBy("feature").agg(
        F.count_if(F.col("value") > 0).alias("_n"), F.sum("value").alias("_v"))
    return members.join(stats, "feature", "left").select(
        "feature", "genus", (F.coalesce("_n", F.lit(0)) / n).alias("prevalence"),
        (F.coalesce("_v", F.lit(0.0)) / n).alias("mean_abundance"))

