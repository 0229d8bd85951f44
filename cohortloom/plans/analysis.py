"""The cohort analysis as one set of linked tables.

Each step is written once and read by the steps after it, the way a batch of
jobs hands tables on.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import composition, meta, moments, stability, sweeps
from ..session import settle


class CohortAnalysis:
    """Lazily built tables of one data set: ``samples(sample_id, cohort, condition, ...)``
    and the non-zero ``abundance(sample_id, feature, value)``."""

    def __init__(self, samples: DataFrame, abundance: DataFrame, prevalence: float = 0.05, min_cohorts: int = 3):
        self.samples, self.abundance = samples, abundance
        self.prevalence, self.min_cohorts = prevalence, min_cohorts

    @cached_property
    def landscape(self) -> DataFrame:
        return settle(composition.feature_landscape(self.samples, self.abundance, self.prevalence, self.min_cohorts))

    @cached_property
    def features(self) -> DataFrame:
        return settle(composition.retained_features(self.landscape))

    @cached_property
    def counts(self) -> DataFrame:
        return settle(moments.cohort_counts(self.samples))

    @cached_property
    def moments(self) -> DataFrame:
        return settle(moments.clr_moments(self.samples, self.abundance, self.features))

    @cached_property
    def association(self) -> DataFrame:
        return settle(moments.association_screen(self.moments, self.counts))

    @cached_property
    def median_gaps(self) -> DataFrame:
        return settle(stability.cohort_median_gaps(self.samples, self.abundance, self.features))

    @cached_property
    def stability(self) -> DataFrame:
        agreement = stability.median_stability(self.median_gaps, self.association)
        return settle(self.association.select("feature", "coef", "pvalue", "qvalue").join(agreement, "feature"))

    @cached_property
    def stable(self) -> DataFrame:
        return settle(stability.stable_candidates(self.stability))

    @cached_property
    def leave_one_out(self) -> DataFrame:
        return settle(moments.leave_one_out_screen(self.moments, self.counts))

    @cached_property
    def rescreen(self) -> DataFrame:
        return settle(sweeps.leave_one_out_rescreen(self.samples, self.abundance, self.features))

    @cached_property
    def rescreen_flags(self) -> DataFrame:
        """Flags of the stable candidates in every leave-one-out rescreen."""
        flagged = stability.flag_against_baseline(self.rescreen, self.association)
        return settle(flagged.join(self.stable.select("feature"), "feature", "left_semi"))

    @cached_property
    def rescreen_summary(self) -> DataFrame:
        return settle(stability.leave_one_out_summary(self.rescreen_flags))

    @cached_property
    def welch(self) -> DataFrame:
        return settle(meta.welch_effects(self.moments))

    @cached_property
    def meta(self) -> DataFrame:
        return settle(meta.meta_table(self.welch))

    @cached_property
    def clr(self) -> DataFrame:
        """The CLR of the non-zero rows with sample attributes."""
        return composition.clr_rows(self.samples, self.abundance, self.features)

    @property
    def feature_count(self) -> Column:
        return self.features.agg(F.count(F.lit(1))).scalar()
