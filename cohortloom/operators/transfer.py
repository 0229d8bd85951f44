"""How well panels transfer between cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..session import settle, spread
from .elasticnet import Fitted, Model, coefficient_table, fit_models, predictions, rank_metrics
from .ranking import class_rank_metrics
from .resample import stratified_folds


class TransferStudy:
    """Panels evaluated on profiles ``(sample_id, cohort, condition, x)``, and ``fold`` if the samples have it:
    then the arrays are not moved to meet it.

    ``names`` lists the features in the order of ``x``.  Panels are tables
    (panel, feature), with a ``repeat`` for random panels and a ``held_out``
    where a panel belongs to one fold.
    """

    def __init__(self, profiles: DataFrame, names: Sequence[str], seed: int = 42):
        self.names = list(names)
        if "fold" not in profiles.columns:
            folds = stratified_folds(profiles.select("sample_id", "cohort", "condition"), seed).select("sample_id", "fold")
            profiles = spread(profiles.join(folds, "sample_id"), "sample_id")
        self.rows = settle(profiles.select("sample_id", "cohort", "condition", "x", "fold"))
        counts = self.rows.groupBy("cohort").agg(
            F.sum("condition").alias("n1"), F.count(F.lit(1)).alias("n")).collect()
        self.sizes = {r["cohort"]: (int(r["n1"]), int(r["n"] - r["n1"])) for r in counts}
        self.fitted: list[Fitted] = []

    def _panels(self, panels: DataFrame) -> list:
        place = {f: i for i, f in enumerate(self.names)}
        keys = ["panel"] + [c for c in ("repeat", "held_out") if c in panels.columns]
        grouped = panels.groupBy(*keys).agg(F.array_sort(F.collect_set("feature")).alias("features")).collect()
        return [(r["panel"], r["repeat"] if "repeat" in keys else 0, r["held_out"] if "held_out" in keys else None,
                 tuple(place[f] for f in r["features"])) for r in sorted(grouped, key=lambda r: tuple(str(r[k]) for k in keys))]

    def _evaluate(self, models: list[Model], facts: DataFrame, on: list[str]) -> DataFrame:
        self.fitted = fit_models(self.rows, models)
        scored = settle(predictions(self.rows, self.fitted).join(facts.select("key", *[c for c in on if c != "test"]), "key"))
        self.scored = scored
        return scored

    def leave_one_out(self, panels: DataFrame, keep_scores: bool = True) -> DataFrame:
        """Train on the other cohorts, test on the one left out.

        Without ``keep_scores`` no table of a row for each panel and sample is made: for many panels.
        """
        models, facts = [], []
        total1, total0 = (sum(v[g] for v in self.sizes.values()) for g in (0, 1))
        for panel, repeat, only, columns in self._panels(panels):
            for cohort, (n1, n0) in sorted(self.sizes.items()):
                if only is not None and only != cohort:
                    continue
                key = len(facts)
                ok = bool(columns) and n1 > 0 and n0 > 0 and total1 > n1 and total0 > n0
                facts.append((key, panel, repeat, len(columns), cohort, total1 + total0 - n1 - n0, n1 + n0, n1, n0,
                              "COMPUTED" if ok else "SKIPPED_SINGLE_CLASS"))
                if ok:
                    models.append(Model(key, panel, repeat, "others", cohort, -1, columns))
        table = self.rows.sparkSession.createDataFrame(
            facts, "key int, panel string, repeat int, panel_size int, held_out string, n_train long, n_test long, "
                   "n_test_case long, n_test_control long, status string")
        if keep_scores:
            scored = self._evaluate(models, table, ["panel", "repeat"])
            metrics = class_rank_metrics(scored, ["key"], "probability", "condition").select("key", "auroc", "average_precision")
        else:
            self.fitted, self.scored = fit_models(self.rows, models), None
            metrics = rank_metrics(self.rows, self.fitted)
        return table.join(metrics, "key", "left").drop("key")

    def pairwise(self, panels: DataFrame, diagonal: str = "insample") -> DataFrame:
        """Train on one cohort, test on every cohort.

        The diagonal is scored in-sample or by stratified folds ("cv").
        """
        if diagonal not in ("insample", "cv"):
            raise ValueError(f"unknown diagonal: {diagonal}")
        models, facts, folds = [], [], []
        for panel, repeat, _, columns in self._panels(panels):
            for train, (n1, n0) in sorted(self.sizes.items()):
                if not n1 or not n0 or not columns:
                    continue
                key = len(models)
                models.append(Model(key, panel, repeat, "own", train, -1, columns))
                own = [key]
                if diagonal == "cv":
                    for fold in range(max(3, min(5, n1, n0))):
                        own.append(len(models))
                        models.append(Model(own[-1], panel, repeat, "own_but_fold", train, fold, columns))
                folds += [(k, key, k != key) for k in own]
                for test, (t1, t0) in sorted(self.sizes.items()):
                    same = train == test
                    status = ("SKIPPED_ONE_CLASS_TEST" if not t1 or not t0 else
                              "TRAIN_ONE_TEST_OTHER" if not same else
                              "WITHIN_COHORT_CV" if diagonal == "cv" else "IN_SAMPLE")
                    facts.append((key, panel, repeat, len(columns), train, test, same, n1 + n0, t1 + t0, status))
        spark = self.rows.sparkSession
        table = spark.createDataFrame(
            facts, "fit int, panel string, repeat int, panel_size int, train_cohort string, test_cohort string, "
                   "is_diagonal boolean, n_train long, n_test long, status string")
        origin = spark.createDataFrame(folds, "key int, fit int, is_fold boolean")
        self.fitted = fit_models(self.rows, models)
        trained = table.select("fit", "train_cohort").distinct()
        scored = predictions(self.rows, self.fitted).join(origin, "key").join(trained, "fit")
        if diagonal == "cv":
            # inside the training cohort only the held-out folds count
            scored = scored.filter((F.col("cohort") != F.col("train_cohort")) | F.col("is_fold"))
        metrics = class_rank_metrics(settle(scored.withColumnRenamed("cohort", "test_cohort")), ["fit", "test_cohort"],
                                     "probability", "condition").select("fit", "test_cohort", "auroc", "average_precision")
        return table.join(metrics, ["fit", "test_cohort"], "left").drop("fit")

    def coefficients(self) -> DataFrame:
        return coefficient_table(self.rows, self.fitted, self.names)

    def held_out_predictions(self) -> DataFrame:
        return self.scored


def _median(column: str, where: Column | None = None) -> Column:
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.percentile(value, F.lit(0.5))


def _iqr(column: str, where: Column | None = None) -> Column:
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))


def leave_one_out_summary(folds: DataFrame, keys: Sequence[str] = ("panel",)) -> DataFrame:
    """Median, range, IQR and test-weighted AUROC over folds."""
    known = F.col("auroc").isNotNull()
    return folds.groupBy(*keys).agg(
        F.max("panel_size").alias("panel_size"), F.countDistinct("held_out").alias("folds"),
        _median("auroc").alias("median_auroc"), F.min("auroc").alias("minimum_auroc"), F.max("auroc").alias("maximum_auroc"),
        _iqr("auroc").alias("auroc_iqr"), _median("average_precision").alias("median_average_precision"),
        ratio(F.sum(F.col("auroc") * F.col("n_test")), F.sum(F.when(known, F.col("n_test"))).cast("double")).alias("weighted_auroc"))


def pairwise_summary(pairs: DataFrame, keys: Sequence[str] = ("panel",)) -> DataFrame:
    """Off-diagonal AUROC, the diagonal median and their gap (transferability loss)."""
    off, diag = ~F.col("is_diagonal"), F.col("is_diagonal")
    out = pairs.groupBy(*keys).agg(
        F.max("panel_size").alias("panel_size"), F.count_if(off).alias("pairs"),
        _median("auroc", off).alias("off_diagonal_median_auroc"),
        F.min(F.when(off, F.col("auroc"))).alias("off_diagonal_minimum_auroc"),
        F.max(F.when(off, F.col("auroc"))).alias("off_diagonal_maximum_auroc"),
        _iqr("auroc", off).alias("off_diagonal_auroc_iqr"),
        _median("average_precision", off).alias("off_diagonal_median_average_precision"),
        F.count_if(off & (F.col("auroc") > 0.5)).alias("off_diagonal_above_half"),
        _median("auroc", diag).alias("within_cohort_median_auroc"))
    return out.withColumn("transferability_loss", F.col("within_cohort_median_auroc") - F.col("off_diagonal_median_auroc"))


def transfer_matrix(pairs: DataFrame, cohorts: Sequence[str] | None = None) -> DataFrame:
    """Train x test AUROC, one column per test cohort."""
    grouped = pairs.groupBy("train_cohort").pivot("test_cohort", list(cohorts) if cohorts else None)
    return grouped.agg(F.first("auroc"))


def random_panel_summary(folds: DataFrame, observed: DataFrame, keys: Sequence[str] = ("held_out", "panel")) -> DataFrame:
    """Random panels per fold with quantiles and the empirical p of observed AUROCs.

    ``observed`` has (held_out, observed, auroc): one row per compared panel.
    """
    stats = folds.groupBy(*keys).agg(
        F.count("auroc").alias("n_random_panels"), _median("auroc").alias("median_auroc"), F.avg("auroc").alias("mean_auroc"),
        _iqr("auroc").alias("auroc_iqr"), F.percentile("auroc", F.lit(0.025)).alias("auroc_025"),
        F.percentile("auroc", F.lit(0.975)).alias("auroc_975"), _median("average_precision").alias("median_average_precision"))
    compared = (folds.join(observed.select("held_out", "observed", F.col("auroc").alias("observed_auroc")), "held_out")
                .groupBy(*keys, "observed").agg(
        F.max("observed_auroc").alias("observed_auroc"),
        F.when(F.max("observed_auroc").isNotNull(),
               (1 + F.count_if(F.col("auroc") >= F.col("observed_auroc"))) / (F.count("auroc") + 1)).alias("empirical_p")))
    return stats.join(compared, list(keys))


def repeat_aggregate(per_repeat: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("panel",)) -> DataFrame:
    """Median and IQR over repeats of each per-repeat metric."""
    parts = [F.count(F.lit(1)).alias("random_repeats")]
    for c in columns:
        parts += [_median(c).alias(c), _iqr(c).alias(f"{c}_random_iqr")]
    return per_repeat.groupBy(*keys).agg(*parts)


def panel_differences(folds: DataFrame, comparisons: Sequence[tuple[str, str]], on: Sequence[str],
                      metric: str = "auroc") -> DataFrame:
    """(comparison, *on, difference): panel b minus panel a at the same fold or pair."""
    out = None
    for a, b in comparisons:
        left = folds.filter(F.col("panel") == a).select(*on, F.col(metric).alias("_a"))
        right = folds.filter(F.col("panel") == b).select(*on, F.col(metric).alias("_b"))
        part = left.join(right, list(on)).select(
            F.lit(f"{b} minus {a}").alias("comparison"), *on, (F.col("_b") - F.col("_a")).alias("difference"))
        out = part if out is None else out.unionByName(part)
    return out.filter("difference IS NOT NULL")


def decision_rules(comparison: DataFrame, variance: DataFrame) -> DataFrame:
    """Which claims the numbers support: a comparison needs a lower bound above 0."""
    compared = comparison.select(F.concat(F.lit("outperforms: "), "comparison").alias("claim"),
                                 (F.col("bootstrap_ci_low") > 0).alias("supported"))
    share = variance.agg(
        F.max(F.when(F.col("term") == "cohort", F.col("term_deletion_r2"))).alias("c"),
        F.max(F.when(F.col("term") == "condition", F.col("term_deletion_r2"))).alias("d"))
    structure = share.select(F.lit("cohort explains more than condition").alias("claim"), (F.col("c") > F.col("d")).alias("supported"))
    return structure.unionByName(compared).select(
        "claim", F.when(F.coalesce("supported", F.lit(False)), "yes").otherwise("no").alias("supported_yes_no"))
