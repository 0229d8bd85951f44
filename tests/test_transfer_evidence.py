import numpy as np
import pyarrow as pa
import pytest
from planted import auroc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortloom.functions.stats import normal_two_sided
from cohortloom.operators import elasticnet, evidence, transfer


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        y = int(rng.random() < 0.45)
        x = rng.normal(0, 1, 6) * [1, 2, 3, 1, 1, 1]
        x[0] += 1.2 * y
        x[3] -= 0.8 * y
        rows.append((i, "abcd"[i % 4], y, [float(v) for v in x]))
    rows += [(200 + i, "solo", 1, [0.0] * 6) for i in range(3)]
    return spark.createDataFrame(rows, "sample_id long, cohort string, condition int, x array<double>")


NAMES = [f"f{i}" for i in range(6)]


def test_fit_equals_spark_ml_on_the_same_objective(profiles):
    study = transfer.TransferStudy(profiles.filter("cohort <> 'solo'"), NAMES)
    model = elasticnet.Model(0, "p", 0, "others", "a", -1, (0, 1, 2, 3, 4, 5))
    got = elasticnet.fit_models(study.rows, [model])[0]
    train = study.rows.filter("cohort <> 'a'")
    n, n1 = train.count(), train.filter("condition = 1").count()
    scaled = train.select(
        F.col("condition").cast("double").alias("label"),
        F.when(F.col("condition") == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1))).alias("w"),
        array_to_vector(F.array(*[(F.col("x")[i] - float(got.mean[i])) / float(got.scale[i]) for i in range(6)])).alias("features"))
    ml = LogisticRegression(elasticNetParam=0.5, regParam=1 / (0.5 * n), weightCol="w", standardization=False,
                            maxIter=2000, tol=1e-12).fit(scaled)
    assert got.weights == pytest.approx(ml.coefficients.toArray(), abs=2e-4)
    assert got.intercept == pytest.approx(ml.intercept, abs=2e-4)


def test_leave_one_out_statuses_metrics_and_summary(profiles, spark):
    study = transfer.TransferStudy(profiles, NAMES)
    panel = spark.createDataFrame([("all", f) for f in NAMES] + [("pair", "f0"), ("pair", "f3")], "panel string, feature string")
    rows = study.leave_one_out(panel).collect()
    assert len(rows) == 10
    by = {(r.panel, r.held_out): r for r in rows}
    assert by[("all", "solo")].status == "SKIPPED_SINGLE_CLASS" and by[("all", "solo")].auroc is None
    assert by[("all", "a")].n_train == 123 and by[("all", "a")].n_test == 40 and by[("all", "a")].auroc > 0.7
    predicted = study.held_out_predictions().filter("panel = 'all' AND cohort = 'b'").collect()
    assert by[("all", "b")].auroc == pytest.approx(auroc(np.array([r.condition for r in predicted]),
                                                         np.array([r.probability for r in predicted])))
    weights = {r.feature: r for r in elasticnet.feature_weights(study.coefficients().filter("panel = 'all'")).collect()}
    assert weights["f0"].mean_weight > 0 > weights["f3"].mean_weight


def test_pairwise_diagonals_and_loss(profiles, spark):
    study = transfer.TransferStudy(profiles, NAMES)
    panel = spark.createDataFrame([("all", f) for f in NAMES], "panel string, feature string")
    inside = {(r.train_cohort, r.test_cohort): r for r in study.pairwise(panel).collect()}
    crossed = {(r.train_cohort, r.test_cohort): r for r in study.pairwise(panel, "cv").collect()}
    assert len(inside) == 20 and inside[("a", "solo")].auroc is None and inside[("a", "a")].is_diagonal
    assert inside[("a", "a")].auroc > crossed[("a", "a")].auroc
    assert inside[("a", "b")].auroc == pytest.approx(crossed[("a", "b")].auroc)
    assert crossed[("a", "a")].status == "WITHIN_COHORT_CV" and crossed[("a", "solo")].status == "SKIPPED_ONE_CLASS_TEST"
    with pytest.raises(ValueError):
        study.pairwise(panel, "none")


def test_fold_panels_are_used_in_their_fold_only(profiles, spark):
    study = transfer.TransferStudy(profiles, NAMES)
    own = spark.createDataFrame([("t", "a", "f0"), ("t", "b", "f1")], "panel string, held_out string, feature string")
    assert {r.held_out for r in study.leave_one_out(own).collect()} == {"a", "b"}


# Published held-out results per cohort (training rows, AUROC) of 1,395 samples.
HELD_OUT = ((1288, 0.799), (1335, 0.821), (1340, 0.573), (1342, 0.714), (1335, 0.637), (1315, 0.923), (1291, 0.696),
            (1270, 0.801), (886, 0.698), (1267, 0.752), (1281, 0.769))


def test_published_held_out_summary(spark):
    rows = [("all", 301, f"c{i}", n, 1395 - n, a, None) for i, (n, a) in enumerate(HELD_OUT)]
    folds = spark.createDataFrame(rows, "panel string, panel_size int, held_out string, n_train long, n_test long, auroc double, average_precision double")
    got = transfer.leave_one_out_summary(folds).first()
    assert (got.folds, got.median_auroc, got.minimum_auroc) == (11, 0.752, 0.573)
    assert got.weighted_auroc == pytest.approx(0.737, abs=5e-4)


def test_published_intervals_give_the_published_p(spark):
    """Coefficient, interval and p of three guild scores."""
    rows = [(-0.5003325505084116, -0.626011160837951, -0.3746539401788722, 6.05227408414024e-15),
            (0.1863026915218251, 0.0200323885855059, 0.3525729944581444, 0.028081746896139),
            (0.2984192003710648, 0.176245773947307, 0.4205926267948225, 1.688968449572786e-06)]
    df = spark.createDataFrame(rows, "coef double, lo double, hi double, p double").withColumn(
        "z", F.col("coef") / ((F.col("hi") - F.col("lo")) / (2 * 1.96)))
    for r in df.select("p", normal_two_sided("z").alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-9)


def test_composite_counts_missing_parts_as_zero_and_ranks_all(spark):
    assoc = spark.createDataFrame([("a", 1.0, 0.01), ("b", -1.0, 0.1), ("c", 1.0, None)], "feature string, coef double, qvalue double")
    stab = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "feature string, stability_fraction double")
    comp = spark.createDataFrame([("a", 0.05, True), ("b", 0.05, False)], "feature string, other_qvalue double, direction_concordant boolean")
    weights = spark.createDataFrame([("a", 1.0, 0.6)], "feature string, mean_abs_weight double, selected_fraction double")
    got = {r.feature: r for r in evidence.composite_score(assoc, stab, comp, weights).collect()}
    assert got["a"].score == pytest.approx(2 * 0.5 * 1.0 * 2) and got["b"].score == pytest.approx(0.5) and got["c"].score == 0
    assert [got[f].score_rank for f in "abc"] == [1, 2, 3]


def test_external_overlap_fans_out_and_skips_empty_genus(spark):
    assoc = spark.createDataFrame([("k__x|g__A|s__A_1", 0.01, 0.02), ("plain", 0.02, 0.02)], "feature string, pvalue double, qvalue double")
    stab = assoc.select("feature", F.lit(1.0).alias("stability_fraction"))
    outside = spark.createDataFrame([("k__x|g__A", 1.0), ("k__x;g__A;s__z", 2.0), ("nothing", 3.0)], "feature string, crc_one double")
    rows = evidence.external_overlap(assoc, stab, outside).collect()
    assert sorted(r.match_status for r in rows) == ["GENUS_MATCH", "GENUS_MATCH", "NO_GENUS_MATCH"]
    loose = evidence.external_overlap(assoc, stab, outside, match_empty_genus=True).collect()
    assert all(r.match_status == "GENUS_MATCH" for r in loose) and len(loose) == 3
    assert evidence.prefixed_columns(outside, "crc_") == ["crc_one"]


def test_decisions_need_a_positive_lower_bound(spark):
    rows = spark.createDataFrame([("b minus a", 0.01), ("c minus a", -0.02)], "comparison string, bootstrap_ci_low double")
    share = spark.createDataFrame([("cohort", 0.08), ("condition", 0.005)], "term string, term_deletion_r2 double")
    assert {r.claim: r.supported_yes_no for r in transfer.decision_rules(rows, share).collect()} == {
        "cohort explains more than condition": "yes", "outperforms: b minus a": "yes", "outperforms: c minus a": "no"}


def test_rank_metrics_equal_those_of_rows(profiles, spark):
    """Scores sent as packed arrays, with ties and a cohort of one class, rank like a row for each score."""
    study = transfer.TransferStudy(profiles.unionAll(profiles.withColumn("sample_id", F.col("sample_id") + 1000)), NAMES)
    panel = spark.createDataFrame([("all", f) for f in NAMES] + [("pair", "f0"), ("pair", "f3")], "panel string, feature string")
    with_rows = {(r.panel, r.held_out): r for r in study.leave_one_out(panel).collect()}
    without = {(r.panel, r.held_out): r for r in study.leave_one_out(panel, keep_scores=False).collect()}
    assert with_rows.keys() == without.keys() and study.held_out_predictions() is None
    for k, r in with_rows.items():
        assert without[k][:-2] == r[:-2]
        assert (without[k].auroc, without[k].average_precision) == pytest.approx((r.auroc, r.average_precision), abs=1e-12) if r.auroc else without[k].auroc is None
    p, q = np.array([0.5, 0.25, 0.5]), np.array([1.0, 1e-200])
    assert [v.tolist() for v in elasticnet._unpacked_scores(3, 2, pa.scalar(elasticnet._packed_scores(p, q)))] == [[0.25, 0.5, 0.5], [1e-200, 1.0]]


def test_random_panel_benchmark_fits_500_panels_of_each_kind_and_fold(spark, monkeypatch):
    """Before, 20 of 500 random panels were fitted, and the unmatched ones were one set for all folds."""
    from cohortloom.plans import queries_transfer

    class Enough(Exception):
        pass

    class Study:
        def leave_one_out(self, panels, **kwargs):
            found.append(panels)
            raise Enough

    found, analysis = [], queries_transfer.panel_tables(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(queries_transfer, "study", lambda *args: (analysis, Study()))
    monkeypatch.setattr(queries_transfer, "loso_results", lambda *args: analysis)
    monkeypatch.setattr(queries_transfer, "training_results", lambda *args: analysis)
    with pytest.raises(Enough):
        queries_transfer.random_panel_benchmark(spark, "/root/testdata/sf0.001")
    got = found[0].groupBy("panel", "held_out", "repeat").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("f")).collect()
    folds = {r.held_out for r in got}
    assert len(folds) == 5 and len(got) == 2 * 5 * 500
    free = {(r.held_out, r.repeat): r.f for r in got if r.panel == "random_unmatched"}
    assert len(free) == 2500 and any(free[h, 1] != free[g, 1] for h in folds for g in folds)
