import numpy as np
import pytest
from planted import bh, dense_clr, dummies, ols_hc3, planted, tables
from pyspark.sql import functions as F

from cohortloom.operators import composition, linear, meta, moments, stability, sweeps
from cohortloom.plans.analysis import CohortAnalysis


@pytest.fixture(scope="module")
def data(spark):
    meta_rows, x = planted()
    samples, abundance = tables(spark, meta_rows, x)
    a = CohortAnalysis(samples, abundance, 0.05, 2)
    features = sorted(r.feature for r in a.features.collect())
    return meta_rows, x, a, features, dense_clr(x, features)


def test_filter_drops_the_all_zero_feature(data):
    meta_rows, x, a, features, _ = data
    assert features == sorted(c for c in x.columns if (x[c] > 0).mean() >= 0.05)
    row = {r.feature: r for r in a.landscape.collect()}[x.columns[2]]
    assert row.cohorts_present == x.loc[x[x.columns[2]] > 0].assign(c=meta_rows.cohort).c.nunique()


def test_pooled_and_left_out_screens_equal_full_regression(data):
    meta_rows, _, a, features, clr = data
    cohort, condition = meta_rows.cohort.to_numpy(), meta_rows.condition.to_numpy(float)
    fits = {("ALL", r.feature): r for r in a.association.collect()}
    fits.update({(r.left_out, r.feature): r for r in a.leave_one_out.collect()})
    for left in ("ALL", "a", "b", "c"):
        keep = cohort != left
        design = np.column_stack([np.ones(keep.sum()), condition[keep], dummies(cohort[keep])])
        p = []
        for j, name in enumerate(features):
            beta, se = ols_hc3(clr[keep, j], design, 1)
            got = fits[(left, name)]
            assert got.coef == pytest.approx(beta, abs=1e-9) and got.se == pytest.approx(se, rel=1e-8)
            p.append(got.pvalue)
        assert [fits[(left, f)].qvalue for f in features] == pytest.approx(list(bh(np.array(p))))


def test_planted_features_are_found(data):
    _, x, a, _, _ = data
    first = a.association.orderBy("pvalue").limit(2).collect()
    assert {r.feature for r in first} == {x.columns[0], x.columns[1]}
    assert {r.feature: r.direction for r in first}[x.columns[0]] == "CRC_higher"


def test_rescreen_redoes_pseudocount_and_clr(data):
    meta_rows, x, a, features, _ = data
    got = {(r.left_out, r.feature): r for r in a.rescreen.collect()}
    for left in ("a", "b", "c"):
        keep = (meta_rows.cohort != left).to_numpy()
        clr = dense_clr(x.loc[keep].reset_index(drop=True), features)
        cohort = meta_rows.cohort[keep].to_numpy()
        design = np.column_stack([np.ones(keep.sum()), meta_rows.condition[keep], dummies(cohort)])
        for j, name in enumerate(features):
            assert got[(left, name)].coef == pytest.approx(ols_hc3(clr[:, j], design, 1)[0], abs=1e-9)


def test_covariate_screen_equals_full_regression(data):
    meta_rows, _, a, features, clr = data
    keep = meta_rows.age.notna().to_numpy()
    m = meta_rows[keep]
    design = np.column_stack([np.ones(len(m)), m.condition, m.age, m.bmi, dummies(m.gender), dummies(m.cohort)])
    screens = linear.LinearScreens(a.samples, a.abundance, a.features)
    got = {r.feature: r for r in screens.covariate_screen(
        linear.build_design(a.samples, ["age", "bmi"], ["gender", "cohort"])).collect()}
    for j, name in enumerate(features):
        beta, se = ols_hc3(clr[keep, j], design, 1)
        assert got[name].coef == pytest.approx(beta, abs=1e-8) and got[name].se == pytest.approx(se, rel=1e-6)


def test_variance_shares_equal_residual_sums(data):
    meta_rows, _, a, _, clr = data
    screens = linear.LinearScreens(a.samples, a.abundance, a.features)
    shares = screens.shares(linear.build_design(a.samples, [], ["cohort"]))
    centred = clr - clr.mean(axis=0)
    design = np.column_stack([np.ones(len(clr)), dummies(meta_rows.cohort)])
    residual = centred - design @ np.linalg.lstsq(design, centred, rcond=None)[0]
    assert shares.total == pytest.approx((centred ** 2).sum())
    assert shares.term("cohort", [])["r2"] == pytest.approx(1 - (residual ** 2).sum() / (centred ** 2).sum())
    table = {r.term: r for r in linear.sequential_partition(shares, ["cohort", "condition"]).collect()}
    assert sum(r.r2 for r in table.values()) == pytest.approx(1.0)


def test_permuted_terms_keep_counts_and_null_statistics(data, spark):
    meta_rows, _, a, features, clr = data
    screens = linear.LinearScreens(a.samples, a.abundance, a.features)
    design = linear.build_design(a.samples, [], ["cohort"])
    shares = screens.shares(design)
    moved = linear.permuted_terms(design, "condition", 5, 3, True).join(a.samples, "sample_id").collect()
    for k in range(5):
        for cohort in "abcd":
            mine = [r for r in moved if r.cohort == cohort]
            assert sum(r.zp[k] for r in mine) == sum(r.condition for r in mine)
    null = linear.PermutationStudy(shares, composition.dense_clr(a.samples, a.abundance, a.features)).pseudo_f(
        "condition", ["cohort"], 5, 3, True).collect()
    base = np.column_stack([np.ones(len(clr)), dummies(meta_rows.cohort)])
    by_id = {r.sample_id: r for r in moved}

    def rss(design):
        return ((clr - design @ np.linalg.lstsq(design, clr, rcond=None)[0]) ** 2).sum()

    for r in null:
        full = np.column_stack([base, [by_id[s].zp[r.perm - 1] for s in meta_rows.sample_id]])
        df = len(clr) - np.linalg.matrix_rank(full)
        assert r.pseudo_f == pytest.approx((rss(base) - rss(full)) / (rss(full) / df), rel=1e-6)


def test_clr_rows_sum_to_zero_and_match_the_dense_profiles(data):
    meta_rows, _, a, features, clr = data
    rows = {r.sample_id: r.x for r in composition.dense_clr(a.samples, a.abundance, a.features).collect()}
    got = np.array([rows[s] for s in meta_rows.sample_id])
    assert got == pytest.approx(clr) and np.abs(got.sum(axis=1)).max() < 1e-9


def test_welch_status_rows_and_random_effects(data):
    _, _, a, features, _ = data
    status = {r.cohort: r.status for r in a.welch.collect()}
    assert status["d"] == "INSUFFICIENT_GROUP_SIZE" and status["a"] == "COMPUTED"
    rows = a.welch.filter(F.col("feature") == features[0]).collect()
    y = np.array([r.effect for r in rows if r.se])
    v = np.array([r.se ** 2 for r in rows if r.se])
    w = 1 / v
    fixed = (w * y).sum() / w.sum()
    q = (w * (y - fixed) ** 2).sum()
    tau2 = max(0.0, (q - len(y) + 1) / (w.sum() - (w ** 2).sum() / w.sum()))
    wr = 1 / (v + tau2)
    got = {r.feature: r for r in a.meta.collect()}[features[0]]
    assert (got.k_cohorts, got.random_effect, got.tau2) == (3, pytest.approx((wr * y).sum() / wr.sum()), pytest.approx(tau2, abs=1e-12))
    few = meta.random_effects(a.welch.filter("cohort IN ('a', 'b')"), ["feature"], 3).collect()
    assert all(r.random_effect is None and r.k_cohorts == 2 for r in few)


def test_median_stability_counts_zero_as_tested(data):
    meta_rows, x, a, features, _ = data
    coef = {r.feature: r.coef for r in a.association.collect()}
    for r in a.stability.collect():
        tested = same = 0
        for cohort in "abc":
            rows = meta_rows.cohort == cohort
            gap = x.loc[rows & (meta_rows.condition == 1), r.feature].median() - x.loc[rows & (meta_rows.condition == 0), r.feature].median()
            tested += 1
            same += np.sign(gap) == np.sign(coef[r.feature])
        assert (r.cohorts_tested, r.cohorts_same_direction) == (tested, same)


def test_constant_and_unknown_errors_are_null(spark):
    samples = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1), (4, "b", 0)], "sample_id long, cohort string, condition int")
    scores = spark.createDataFrame([(i, "flat", 2.0) for i in range(1, 5)] + [(1, "one", 1.0), (2, "one", 0.0), (3, "one", 3.0), (4, "one", 1.0)],
                                   "sample_id long, feature string, score double")
    table = moments.score_moments(samples, scores)
    fits = moments.screen(table, moments.design_weights(moments.pooled_design(moments.cohort_counts(samples)))).collect()
    got = {r.feature: r for r in fits}
    assert got["flat"].coef is None and got["one"].coef == pytest.approx(1.5)
    single = moments.single_cohort_screen(table, moments.cohort_counts(samples)).filter("feature = 'one'").collect()
    assert all(r.se is None and r.pvalue is None for r in single)


def test_threshold_sweep_counts(spark):
    rows = spark.createDataFrame([("x", 1.0, 0.04, 0.85), ("y", -1.0, 0.09, 0.65), ("z", 1.0, 0.5, 1.0)],
                                 "feature string, coef double, qvalue double, stability_fraction double")
    got = {(r.fdr_cutoff, r.same_direction_threshold): (r.candidate_count, r.case_higher, r.control_higher)
           for r in sweeps.stability_threshold_sweep(rows).collect()}
    assert len(got) == 8 and got[(0.10, 0.60)] == (2, 1, 1) and got[(0.05, 0.80)] == (1, 1, 0)
    assert stability.stable_candidates(rows).count() == 2
