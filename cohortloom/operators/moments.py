"""Cohort moments of a feature and the cohort-adjusted screens built on them.

Condition is binary, so the regression ``clr ~ condition + cohort`` with HC3
errors is a function of counts, means and variances per (feature, cohort,
condition).  A screen over any set of training cohorts is one join of the
moment table with a table of design weights: the pooled screen, every
leave-one-cohort-out screen and every single-cohort screen share one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import direction, normal_two_sided, ratio
from .composition import keep_features, pseudocount, sample_centres, shifted_logs
from .ranking import bh_adjust

POOLED = "ALL"


def _case(expression: Column) -> Column:
    return F.sum(F.when(F.col("condition") == 1, expression))


def _control(expression: Column) -> Column:
    return F.sum(F.when(F.col("condition") == 0, expression))


def cohort_list(samples: DataFrame) -> Column:
    """Sorted distinct cohorts as one array value (one entry per cohort)."""
    return samples.select("cohort").distinct().agg(F.array_sort(F.collect_list("cohort"))).scalar()


def cohort_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("cohort").agg(
        F.sum((F.col("condition") == 1).cast("bigint")).alias("n1"),
        F.sum((F.col("condition") == 0).cast("bigint")).alias("n0"))


def _finish(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums to means and population variances."""
    def mean(g: int) -> Column:
        return ratio(F.col(f"y{g}"), F.col(f"n{g}").cast("double"))

    def variance(g: int) -> Column:
        return F.greatest(ratio(F.col(f"yy{g}"), F.col(f"n{g}").cast("double")) - mean(g) * mean(g), F.lit(0.0))

    return table.select(*keys, "n1", "n0", mean(1).alias("mean1"), mean(0).alias("mean0"),
                        variance(1).alias("var1"), variance(0).alias("var0"))


def clr_moments(samples: DataFrame, abundance: DataFrame, features: DataFrame, pc: Column | None = None,
                multiplier: float = 0.5, config: DataFrame | None = None) -> DataFrame:
    """(feature, cohort) counts, means and variances of the CLR by condition.

    ``features`` may carry a ``config_id``: then every configuration keeps its
    own feature list and ``config(config_id, pseudocount)`` its own pseudocount,
    and one plan serves the whole grid.
    """
    if "config_id" in features.columns:
        return _config_moments(samples, abundance, features, config)
    kept = keep_features(abundance, features)
    shift = pseudocount(kept, multiplier).scalar() if pc is None else pc
    logs = shifted_logs(kept, shift)
    centres = sample_centres(samples, logs, features.agg(F.count(F.lit(1))).scalar())
    centres = centres.select("sample_id", "cohort", "condition", "s", (F.col("s") * F.col("s")).alias("ss"))
    rows = logs.join(centres, "sample_id").withColumn("w", F.col("u") * F.col("u") - 2 * F.col("u") * F.col("s"))
    return _sparse_moments(rows, centres, features, [])


def _config_moments(samples: DataFrame, abundance: DataFrame, features: DataFrame, config: DataFrame) -> DataFrame:
    """The moments of every configuration from one pass over the rows, none of which is copied.

    Configurations are few: their centres are columns of one row per sample and their sums columns of one row per cell.
    """
    sizes = features.groupBy("config_id").agg(F.count(F.lit(1)).alias("_size"))
    settings = config.join(sizes, "config_id").select("config_id", "pseudocount", "_size").orderBy("config_id").collect()
    shifts = sorted({c["pseudocount"] for c in settings})
    own = features.groupBy("feature").agg(F.collect_set("config_id").alias("_own")).select(
        "feature", *[F.array_contains("_own", c["config_id"]).alias(f"_in{i}") for i, c in enumerate(settings)])
    logs = abundance.filter("value > 0").join(own, "feature").withColumns(
        {f"_u{j}": F.log1p(F.col("value") / F.lit(pc)) for j, pc in enumerate(shifts)})
    us = [F.when(F.col(f"_in{i}"), F.col(f"_u{shifts.index(c['pseudocount'])}")) for i, c in enumerate(settings)]
    # samples without a retained value have s = 0 and need no row of their own here
    centres = (logs.groupBy("sample_id").agg(*[(F.sum(u) / c["_size"]).alias(f"_s{i}") for i, (u, c) in enumerate(zip(us, settings))])
               .join(samples.select("sample_id", "cohort", "condition"), "sample_id"))

    def summed(rows: DataFrame, keys: list[str], **parts: list[Column]) -> DataFrame:
        cells = rows.groupBy(*keys).agg(*[F.sum(p).alias(f"_{name}_{i}") for name, ps in parts.items() for i, p in enumerate(ps)])
        structs = [F.when(F.coalesce(*[F.col(f"_{name}_{i}") for name in parts]).isNotNull(), F.struct(
            F.lit(c["config_id"]).alias("config_id"), *[F.col(f"_{name}_{i}").alias(name) for name in parts]))
            for i, c in enumerate(settings)]
        return cells.select(*keys, F.explode(F.array_compact(F.array(*structs))).alias("_c")).select(*keys, "_c.*")

    ss = [F.col(f"_s{i}") for i in range(len(settings))]
    rows = summed(logs.join(centres, "sample_id"), ["feature", "cohort", "condition"], u=us,
                  w=[u * u - 2 * u * s for u, s in zip(us, ss)])
    base = summed(centres, ["cohort", "condition"], s=ss, ss=[s * s for s in ss])
    return _sparse_moments(rows, base, features, ["config_id"], cohort_counts(samples))


def _sparse_moments(rows: DataFrame, centres: DataFrame, features: DataFrame, keys: list[str],
                    counts: DataFrame | None = None) -> DataFrame:
    """``rows`` are the non-zero rows with cohort, condition, u and w = u^2 - 2us, or their sums; ``centres`` the samples'
    s and ss = s^2, or their sums, which need ``counts``."""
    found = rows.groupBy(*keys, "feature", "cohort").agg(
        _case(F.col("u")).alias("u1"), _control(F.col("u")).alias("u0"),
        _case(F.col("w")).alias("w1"), _control(F.col("w")).alias("w0"))
    base = centres.groupBy(*keys, "cohort").agg(
        F.sum((F.col("condition") == 1).cast("bigint")).alias("n1"),
        F.sum((F.col("condition") == 0).cast("bigint")).alias("n0"),
        _case(F.col("s")).alias("s1"), _control(F.col("s")).alias("s0"),
        _case(F.col("ss")).alias("ss1"), _control(F.col("ss")).alias("ss0"))
    if counts is not None:
        base = base.drop("n1", "n0").join(counts, "cohort")
    # every feature meets every cohort, found there or not
    frame = features.select(*keys, "feature").join(base, keys) if keys else _meet_cohorts(features, base)
    zero = F.lit(0.0)

    def part(name: str) -> Column:
        return F.coalesce(F.col(name), zero)

    joined = frame.join(found, [*keys, "feature", "cohort"], "left")
    for g in (1, 0):
        joined = (joined.withColumn(f"y{g}", part(f"u{g}") - part(f"s{g}"))
                  .withColumn(f"yy{g}", part(f"w{g}") + part(f"ss{g}")))
    return _finish(joined, [*keys, "feature", "cohort"])


def _meet_cohorts(features: DataFrame, base: DataFrame) -> DataFrame:
    cohorts = base.agg(F.collect_list(F.struct(*base.columns))).scalar()
    return features.select("feature", F.explode(cohorts).alias("_c")).select("feature", "_c.*")


def score_moments(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """The same table for dense per-sample scores ``(sample_id, feature, score)``."""
    rows = scores.join(samples.select("sample_id", "cohort", "condition"), "sample_id")
    case, control = F.col("condition") == 1, F.col("condition") == 0
    return rows.groupBy("feature", "cohort").agg(
        F.sum(case.cast("bigint")).alias("n1"), F.sum(control.cast("bigint")).alias("n0"),
        F.avg(F.when(case, F.col("score"))).alias("mean1"), F.avg(F.when(control, F.col("score"))).alias("mean0"),
        F.var_pop(F.when(case, F.col("score"))).alias("var1"), F.var_pop(F.when(control, F.col("score"))).alias("var0"))


def pooled_design(counts: DataFrame) -> DataFrame:
    return counts.withColumn("design_id", F.lit(POOLED))


def leave_one_out_designs(counts: DataFrame) -> DataFrame:
    """design_id = the cohort left out; rows = the cohorts trained on."""
    return (counts.withColumn("design_id", F.explode(cohort_list(counts)))
            .filter(F.col("design_id") != F.col("cohort")))


def single_cohort_designs(counts: DataFrame) -> DataFrame:
    return counts.withColumn("design_id", F.col("cohort"))


def design_weights(designs: DataFrame) -> DataFrame:
    """Weights of every training cohort in its design.

    With the condition centred in the cohort (d), D = sum d^2 and leverage
    h = 1/N + d^2/D, a cell enters the HC3 variance with n (d/D)^2 / (1-h)^2.
    """
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    size = n1 + n0
    shares = designs.withColumn("_d1", ratio(n0, size)).withColumn("_d0", ratio(n1, size)).withColumn(
        "_info", ratio(n1 * n0, size))
    totals = shares.groupBy("design_id").agg(
        F.sum("_info").alias("_D"), F.sum("n1").alias("design_n1"), F.sum("n0").alias("design_n0"))
    joined = shares.join(totals, "design_id")

    def cell(g: int) -> Column:
        d, n = F.col(f"_d{g}"), (n1 if g else n0)
        slack = 1 - ratio(F.lit(1.0), size) - ratio(d * d, F.col("_D"))
        # no slack: one sample carries the whole contrast and the error is unknown
        value = n * ratio(d * d, F.col("_D") * F.col("_D")) / F.nullif(
            F.when(slack > 1e-12, slack * slack).otherwise(F.lit(0.0)), F.lit(0.0))
        return F.when((n == 0) | (d == 0), F.lit(0.0)).otherwise(value)

    return (joined.withColumn("a1", cell(1)).withColumn("a0", cell(0))
            .select("design_id", "cohort", "design_n1", "design_n0",
                    ratio(F.col("_info"), F.col("_D")).alias("w"), "a1", "a0",
                    (F.col("a1") * F.col("_d1") * F.col("_d1") + F.col("a0") * F.col("_d0") * F.col("_d0")).alias("b"),
                    (F.col("a1").isNull() | F.col("a0").isNull()).cast("int").alias("unknown")))


def screen(moments: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Condition coefficient, HC3 error and two-sided normal p per (design, feature).

    A constant feature, a design without contrast or an unknown error gives NULL.
    """
    shared = [k for k in keys if k in weights.columns]
    keys = [*keys, "feature"]
    rows = moments.join(weights, ["cohort", *shared])
    gap = F.coalesce(F.col("mean1") - F.col("mean0"), F.lit(0.0))
    v1, v0 = F.coalesce("var1", F.lit(0.0)), F.coalesce("var0", F.lit(0.0))
    b = F.coalesce("b", F.lit(0.0))
    sums = rows.groupBy("design_id", *keys).agg(
        F.max("design_n1").alias("n1"), F.max("design_n0").alias("n0"),
        F.sum(F.col("w") * gap).alias("_beta"),
        F.sum(F.coalesce("a1", F.lit(0.0)) * v1 + F.coalesce("a0", F.lit(0.0)) * v0).alias("_inner"),
        F.sum(b).alias("_b"), F.sum(b * gap).alias("_bg"), F.sum(b * gap * gap).alias("_bgg"),
        F.max("unknown").alias("_unknown"), F.max(F.greatest(v1, v0)).alias("_spread"),
        F.max(F.greatest("mean1", "mean0")).alias("_top"), F.min(F.least("mean1", "mean0")).alias("_low"))
    scale = F.greatest(F.abs("_top"), F.abs("_low"), F.lit(1e-300))
    constant = (F.col("_top") - F.col("_low") <= 1e-9 * scale) & (F.sqrt("_spread") <= 1e-7 * scale)
    beta = F.col("_beta")
    variance = F.col("_inner") + F.col("_bgg") - 2 * beta * F.col("_bg") + beta * beta * F.col("_b")
    known = ~constant & (F.col("_unknown") == 0)
    return (sums
            .withColumn("coef", F.when(~constant, beta))
            .withColumn("se", F.when(known, F.sqrt(F.greatest(variance, F.lit(0.0)))))
            .withColumn("_z", ratio(F.col("coef"), F.col("se")))
            .withColumn("pvalue", normal_two_sided("_z"))
            .select("design_id", *keys, "n1", "n0", "coef", "se", "pvalue"))


def association_screen(moments: DataFrame, counts: DataFrame, zero_label: str = "zero") -> DataFrame:
    """The pooled cohort-adjusted screen with q values and direction labels."""
    fitted = screen(moments, design_weights(pooled_design(counts))).drop("design_id")
    return bh_adjust(fitted, "pvalue", "qvalue").withColumn("direction", direction(F.col("coef"), zero_label))


def leave_one_out_screen(moments: DataFrame, counts: DataFrame) -> DataFrame:
    """Every leave-one-cohort-out screen, q values within each left-out cohort."""
    fitted = screen(moments, design_weights(leave_one_out_designs(counts)))
    return bh_adjust(fitted, "pvalue", "qvalue", ["design_id"]).withColumnRenamed("design_id", "left_out")


def single_cohort_screen(moments: DataFrame, counts: DataFrame) -> DataFrame:
    """OLS of the feature on condition inside each cohort that has both classes."""
    both = counts.filter("n1 > 0 AND n0 > 0")
    return screen(moments, design_weights(single_cohort_designs(both))).withColumnRenamed("design_id", "cohort")
