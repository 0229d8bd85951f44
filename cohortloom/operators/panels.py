"""Ranked feature panels: from the full data, from training folds, and at random."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..session import settle
from .ranking import grouped_quantiles, row_numbers

# Panel caps and selection thresholds.
TOP_SIZE, HIGH_SIZE = 29, 18
SELECT_Q, STABLE_SHARE, HIGH_SHARE = 0.10, 0.60, 0.80


def _order(*keys: str):
    return Window.partitionBy(*keys).orderBy(
        F.col("qvalue").asc_nulls_last(), F.col("pvalue").asc_nulls_last(), F.col("feature"))


def capped_panel(fits: DataFrame, panel: str, cap: int, where: Column | None = None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """The first ``cap`` rows by (q, p, feature) per key; fewer if fewer qualify."""
    rows = fits if where is None else fits.filter(F.coalesce(where, F.lit(False)))
    return (rows.withColumn("_k", F.lit(0)).withColumn("rank", F.row_number().over(_order("_k", *keys)))
            .filter(F.col("rank") <= cap).drop("_k").withColumn("panel", F.lit(panel)))


def whole_panel(fits: DataFrame, panel: str, keys: Sequence[str] = ()) -> DataFrame:
    """Every feature, ranked by a keyed draw (a panel of all features has no order)."""
    drawn = fits.withColumn("_d", draw(0, "whole", F.col("feature"))).withColumn("_k", F.lit(0))
    ranked = row_numbers(drawn, ["_k", *keys], "_d", "feature", "rank")
    return ranked.drop("_d", "_k").withColumn("panel", F.lit(panel))


def global_panels(association: DataFrame, stable: DataFrame, high: DataFrame,
                  include_all: bool = True) -> DataFrame:
    """(panel, rank, feature): all, leading by q, stable and high-consistency features."""
    columns = ["panel", "rank", "feature"]
    parts = [capped_panel(association, "global_top", TOP_SIZE).select(*columns)]
    if include_all:
        parts.append(whole_panel(association.select("feature"), "all_features").select(*columns))
    for name, members in (("global_stable", stable), ("global_high_consistency", high)):
        rows = association.join(members.select("feature"), "feature", "left_semi").withColumn(
            "_d", F.coalesce("qvalue", F.lit(2.0))).withColumn("_k", F.lit(0))
        parts.append(row_numbers(settle(rows), ["_k"], "_d", "feature", "rank")
                     .withColumn("panel", F.lit(name)).select(*columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("rank", F.col("rank").cast("int"))


def training_panels(fits: DataFrame) -> DataFrame:
    """Panels chosen inside each fold from its training screen.

    ``fits`` has (design_id, feature, coef, pvalue, qvalue, same_direction_fraction).
    """
    keys = ["design_id"]
    significant = F.col("qvalue") < SELECT_Q
    parts = [
        capped_panel(fits, "training_only_top", TOP_SIZE, keys=keys),
        capped_panel(fits, "training_only_stability", TOP_SIZE,
                     significant & (F.col("same_direction_fraction") >= STABLE_SHARE), keys),
        capped_panel(fits, "training_only_high_consistency", HIGH_SIZE,
                     significant & (F.col("same_direction_fraction") >= HIGH_SHARE), keys)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("design_id", "panel", "rank", "feature", "coef", "pvalue", "qvalue", "same_direction_fraction")


def panel_overlap(panels: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size of every panel and how many of its features each reference panel holds."""
    marks = reference.select(F.col("panel").alias("reference"), "feature").distinct()
    sizes = panels.groupBy(*keys).agg(F.countDistinct("feature").alias("panel_size"))
    shared = (panels.select(*keys, "feature").distinct().join(marks, "feature")
              .groupBy(*keys, "reference").agg(F.count(F.lit(1)).alias("overlap")))
    names = marks.select("reference").distinct().agg(F.collect_list("reference")).scalar()
    return (sizes.withColumn("reference", F.explode(names)).join(shared, [*keys, "reference"], "left")
            .withColumn("overlap", F.coalesce("overlap", F.lit(0))))


def random_panels(features: DataFrame, repeats: int, seed: int, size: int = TOP_SIZE,
                  purpose: str = "random_panel", keys: Sequence[str] = ()) -> DataFrame:
    """``repeats`` panels of ``size`` features without replacement, for each of the ``keys`` that ``features`` has.

    The limit by rank keeps only ``size`` rows per repeat in each task.
    """
    rows = features.select(*keys, "feature", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat_id"))
    drawn = rows.withColumn("_d", draw(seed, purpose, *[F.col(k) for k in keys], F.col("repeat_id"), F.col("feature")))
    order = Window.partitionBy(*keys, "repeat_id").orderBy("_d", "feature")
    return drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).drop("_d")


def training_prevalence(samples: DataFrame, abundance: DataFrame, features: DataFrame) -> DataFrame:
    """Prevalence of every feature in the training cohorts of each fold.

    Counts per (feature, cohort) are formed once; a fold is the total less the
    cohort left out.
    """
    n = samples.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))
    total_n = n.agg(F.sum("n")).scalar()
    found = (abundance.filter("value > 0").join(features.select("feature"), "feature", "left_semi")
             .join(samples.select("sample_id", "cohort"), "sample_id")
             .groupBy("feature", "cohort").agg(F.count(F.lit(1)).alias("k")))
    totals = found.groupBy("feature").agg(F.sum("k").alias("total"))
    folds = n.agg(F.collect_list(F.struct(F.col("cohort").alias("design_id"), "n"))).scalar()
    return (features.select("feature", F.explode(folds).alias("_f")).select("feature", "_f.*")
            .join(totals, "feature", "left")
            .join(found.withColumnRenamed("cohort", "design_id"), ["feature", "design_id"], "left")
            .select("design_id", "feature",
                    ((F.coalesce("total", F.lit(0)) - F.coalesce("k", F.lit(0))) / (total_n - F.col("n"))).alias("prevalence")))


def prevalence_bins(prevalence: DataFrame) -> DataFrame:
    """Right-closed quintile bin of a feature among the features of its fold.

    Equal edges collapse; with fewer than three distinct edges there is one bin.
    """
    edges = grouped_quantiles(prevalence, ["design_id"], "prevalence", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)).select(
        "design_id", F.array_sort(F.array_distinct(F.array(*[f"q{i}" for i in range(6)]))).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    bin_no = F.when(F.size("_edges") < 3, F.lit(0)).otherwise(
        F.size(F.filter(inner, lambda e: e < F.col("prevalence"))))
    return prevalence.join(edges, "design_id").select("design_id", "feature", "prevalence", bin_no.alias("bin"))


def matched_random_panels(bins: DataFrame, targets: DataFrame, repeats: int, seed: int,
                          size: int = TOP_SIZE) -> DataFrame:
    """Random panels with the bin counts of the targets, targets themselves excluded.

    A bin takes its quota of the smallest draws among the other features; what a
    short bin leaves open is filled by the smallest draws of the remaining other
    features, and by targets only when those run out.
    """
    marked = bins.join(targets.select("feature", F.lit(1).alias("_t")).distinct(), "feature", "left").withColumn(
        "_t", F.coalesce("_t", F.lit(0)))
    # with more targets than places the bins share the places in proportion, largest remainders first
    counts = marked.filter("_t = 1").groupBy("design_id", "bin").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("design_id")
    shared = (counts.withColumn("_all", F.sum("_n").over(whole)).withColumn("_places", F.least(F.col("_all"), F.lit(size)))
              .withColumn("_quota", F.expr("(_n * _places) div _all")).withColumn("_rest", F.expr("(_n * _places) % _all"))
              .withColumn("_open", F.col("_places") - F.sum("_quota").over(whole))
              .withColumn("_turn", F.row_number().over(whole.orderBy(F.col("_rest").desc(), "bin"))))
    quotas = shared.select("design_id", "bin", (F.col("_quota") + (F.col("_turn") <= F.col("_open")).cast("bigint")).alias("_quota"))
    drawn = (marked.withColumn("repeat_id", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
             .withColumn("_d", draw(seed, "matched_panel", F.col("design_id"), F.col("repeat_id"), F.col("feature"))))
    by_bin = Window.partitionBy("design_id", "repeat_id", "_t", "bin").orderBy("_d", "feature")
    # a bin can give at most its quota and the open places: 2 * size rows
    near = (drawn.withColumn("_r", F.row_number().over(by_bin)).filter(F.col("_r") <= 2 * size)
            .join(quotas, ["design_id", "bin"], "left")
            .withColumn("_first", ((F.col("_t") == 0) & (F.col("_r") <= F.coalesce("_quota", F.lit(0)))).cast("int")))
    fill = Window.partitionBy("design_id", "repeat_id").orderBy(F.col("_first").desc(), "_t", "_d", "feature")
    return (near.withColumn("rank", F.row_number().over(fill)).filter(F.col("rank") <= size)
            .select("design_id", "repeat_id", "rank", "feature", "bin", F.col("_first").alias("from_bin")))
