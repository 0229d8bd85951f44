import numpy as np
import pytest
from planted import planted, tables
from pyspark.sql import functions as F

from cohortloom.operators import guilds, panels, permutation, resample
from cohortloom.plans.analysis import CohortAnalysis


@pytest.fixture(scope="module")
def a(spark):
    return CohortAnalysis(*tables(spark, *planted()), 0.05, 2)


def test_permuted_labels_keep_cohort_counts(a):
    truth = {r.cohort: r.n for r in a.samples.groupBy("cohort").agg(F.sum("condition").alias("n")).collect()}
    rows = permutation.permuted_labels(a.samples, 6, 1).groupBy("perm", "cohort").agg(F.sum("label").alias("n")).collect()
    assert len(rows) == 24 and all(truth[r.cohort] == r.n for r in rows)
    seen = permutation.permuted_labels(a.samples, 6, 1).filter("label = 1").groupBy("perm").agg(
        F.sort_array(F.collect_list("sample_id")).alias("s")).collect()
    assert len({tuple(r.s) for r in seen}) == 6


def test_permuted_column_is_a_rearrangement(a):
    truth = sorted(r.bmi for r in a.samples.collect())
    rows = resample.permuted_column(a.samples, "bmi", 3, 1).collect()
    for k in (1, 2, 3):
        assert sorted(r.value for r in rows if r.perm == k) == truth


def test_label_words_follow_the_draws(a, monkeypatch):
    rows, perms = a.samples.select("sample_id", "cohort", "condition").collect(), 70
    draws = permutation.draws_of(3, perms)([str(r.sample_id) for r in rows])
    want = {}
    for c in {r.cohort for r in rows}:
        mine = [i for i, r in enumerate(rows) if r.cohort == c]
        cases = sum(rows[i].condition for i in mine)
        for p in range(perms):
            order = sorted(mine, key=lambda i: (draws[i, p], rows[i].sample_id))
            want |= {(rows[i].sample_id, p + 1): int(k < cases) for k, i in enumerate(order)}
    for few in (64, 1):  # one round of histograms, or as many as it takes
        monkeypatch.setattr(permutation, "FEW", few)
        assert {(r.sample_id, r.perm): r.label for r in permutation.permuted_labels(a.samples, perms, 3).collect()} == want
    spark_draw = a.samples.select("sample_id", F.expr("cast(conv(substring(md5(concat('3|label|70|', sample_id)), 1, 15), 16, 10) as bigint)").alias("d")).collect()
    assert {r.sample_id: r.d for r in spark_draw} == {r.sample_id: int(d) for r, d in zip(rows, draws[:, 69])}


def test_label_totals_without_rows_per_permutation(a):
    found = {(r.perm, r.cohort): r for r in permutation.label_totals(a.samples, 9, 1).collect()}
    rows = permutation.permuted_labels(a.samples, 9, 1).join(a.samples.select("sample_id", "condition"), "sample_id").collect()
    assert len(found) == 36
    for (perm, cohort), r in found.items():
        mine = [x for x in rows if (x.perm, x.cohort) == (perm, cohort)]
        assert (r.n, r.n_case, r.unchanged) == (len(mine), sum(x.label for x in mine), sum(x.label == x.condition for x in mine))
        assert r.case_key_sum == sum(x.sample_id for x in mine if x.label)


def test_label_permutation_test_matches_distances(a, spark, monkeypatch):
    rng, perms = np.random.default_rng(5), 12
    base = a.samples.select("sample_id", "cohort", "condition").collect()
    u = rng.random((len(base), 5)) * (rng.random((len(base), 5)) < 0.4)
    u[:, 4] = 0  # a feature without rows
    logs = spark.createDataFrame([(r.sample_id, f"f{j}", float(u[i, j])) for i, r in enumerate(base) for j in range(5) if u[i, j]], "sample_id long, feature string, u double")
    centres = spark.createDataFrame([(r.sample_id, float(u[i].mean())) for i, r in enumerate(base)], "sample_id long, s double")
    labels = {(r.sample_id, r.perm): r.label for r in permutation.permuted_labels(a.samples, perms, 2).collect()}
    m = u - u.mean(axis=1, keepdims=True)
    cohort = np.array([r.cohort for r in base])
    for c in set(cohort):
        m[cohort == c] -= m[cohort == c].mean(axis=0)
    for split in (20_000, 7):
        monkeypatch.setattr(permutation, "SPLIT", split)
        got = {r.perm: r.pseudo_f for r in permutation.label_permutation_test(a.samples, logs, centres, 5, perms, 2).collect()}
        assert sorted(got) == list(range(perms + 1))
        for p in got:
            y = np.array([labels[r.sample_id, p] if p else r.condition for r in base])
            groups = [m[y == g] for g in (0, 1)]
            between = sum(len(g) * ((g.mean(axis=0) - m.mean(axis=0)) ** 2).sum() for g in groups)
            within = sum(((g - g.mean(axis=0)) ** 2).sum() for g in groups)
            assert got[p] == pytest.approx(between / (within / (len(m) - 2)))


def test_folds_partition_and_balance(a):
    rows = resample.stratified_folds(a.samples.filter("cohort <> 'd'"), 3).collect()
    assert len(rows) == 95
    for cohort in "abc":
        for condition in (0, 1):
            sizes = np.bincount([r.fold for r in rows if r.cohort == cohort and r.condition == condition])
            assert sizes.max() - sizes.min() <= 1


def test_bootstrap_interval_covers_and_skips_single_class(spark):
    rows = spark.createDataFrame([(i, "a", i % 2, float(i % 2) + (i * 37 % 11) / 8) for i in range(40)],
                                 "sample_id long, cohort string, condition int, score double")
    got = resample.bootstrap_auroc(rows, ["cohort"], "score", "condition", 60, 1).first()
    assert 0.5 < got.ci_low < got.ci_high <= 1.0 and got.replicates_used == 60
    tiny = spark.createDataFrame([(1, "t", 1, 0.2), (2, "t", 0, 0.1)], rows.schema)
    assert resample.bootstrap_auroc(tiny, ["cohort"], "score", "condition", 60, 1).first().replicates_used < 60


def test_signed_rank_and_empirical_p(spark):
    rows = [("up", float(v)) for v in (0.3, 0.1, 0.2, 0.5, 0.4)] + [("none", 0.0), ("none", 0.0)] + [
        ("ties", v) for v in (1.0, -1.0, 2.0, 2.0, 0.0)]
    got = {r.k: r for r in resample.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"], "d").collect()}
    assert got["up"].pvalue == pytest.approx(2 / 32) and got["none"].pvalue is None and 0 < got["ties"].pvalue <= 1
    null = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    assert resample.empirical_p(null, F.lit(7.0), "v").first().empirical_p == pytest.approx(3 / 10)


def test_random_panels_have_no_repeats(a):
    rows = panels.random_panels(a.features, 5, 1, size=4).collect()
    for k in range(1, 6):
        mine = [r.feature for r in rows if r.repeat_id == k]
        assert len(mine) == len(set(mine)) == 4


def test_matched_panels_follow_bins_then_fill(spark):
    bins = spark.createDataFrame([("x", f"f{i:02d}", i / 20, i // 5) for i in range(20)],
                                 "design_id string, feature string, prevalence double, bin int")
    targets = spark.createDataFrame([("f00",), ("f01",), ("f02",), ("f03",), ("f17",)], "feature string")
    rows = panels.matched_random_panels(bins, targets, 8, 1, size=6).collect()
    bin_of = {f"f{i:02d}": i // 5 for i in range(20)}
    for k in range(1, 9):
        mine = [r for r in rows if r.repeat_id == k]
        names = [r.feature for r in mine]
        assert len(set(names)) == 6 and not set(names) & {"f00", "f01", "f02", "f03", "f17"}
        # bin 0 offers one feature besides the targets, so three of its four places are filled elsewhere
        assert sorted(bin_of[r.feature] for r in mine if r.from_bin) == [0, 3]


def test_matched_panels_use_targets_only_when_the_rest_runs_out(spark):
    bins = spark.createDataFrame([("x", f"f{i}", 0.5, 0) for i in range(5)],
                                 "design_id string, feature string, prevalence double, bin int")
    targets = spark.createDataFrame([("f0",), ("f1",), ("f2",)], "feature string")
    rows = panels.matched_random_panels(bins, targets, 1, 1, size=4).collect()
    assert {"f3", "f4"} < {r.feature for r in rows} and len(rows) == 4


def test_prevalence_bins_collapse_equal_edges(spark):
    same = spark.createDataFrame([("x", f"f{i}", 0.5) for i in range(6)], "design_id string, feature string, prevalence double")
    assert {r.bin for r in panels.prevalence_bins(same).collect()} == {0}
    wide = spark.createDataFrame([("x", f"f{i}", i / 10) for i in range(11)], "design_id string, feature string, prevalence double")
    got = {r.feature: r.bin for r in panels.prevalence_bins(wide).collect()}
    assert [got[f"f{i}"] for i in range(11)] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_training_prevalence_leaves_the_cohort_out(a):
    meta, x = planted()
    got = {(r.design_id, r.feature): r.prevalence for r in panels.training_prevalence(a.samples, a.abundance, a.features).collect()}
    for (left, name), value in got.items():
        assert value == pytest.approx((x.loc[meta.cohort != left, name] > 0).mean())


def test_panel_caps_and_overlap(spark):
    fits = spark.createDataFrame([("f", f"t{i:02d}", 1.0, i / 1000, i / 500, 0.5 + i / 100) for i in range(50)],
                                 "design_id string, feature string, coef double, pvalue double, qvalue double, same_direction_fraction double")
    rows = panels.training_panels(fits).collect()
    sizes = {p: sum(r.panel == p for r in rows) for p in {r.panel for r in rows}}
    assert sizes == {"training_only_top": 29, "training_only_stability": 29, "training_only_high_consistency": 18}
    assert {r.feature for r in rows if r.panel == "training_only_stability"} == {f"t{i:02d}" for i in range(10, 39)}


def test_guild_rules_and_scores(a):
    meta, x = planted()
    rules = guilds.rule_table(a.samples.sparkSession, [("one", "g", "G0"), ("one", "f", "F1"), ("two", "s", "G1 s01")])
    members = guilds.guild_membership(a.features, rules)
    got = {(r.guild, r.feature) for r in members.collect()}
    kept = {r.feature for r in a.features.collect()}
    expect = {("one", f) for f in kept if "|g__G0|" in f or "|f__F1|" in f} | {("two", f) for f in kept if f.endswith("G1_s01")}
    assert got == expect and all(r.small == (r.n_features < 3) for r in members.collect())
    from planted import dense_clr
    features = sorted(kept)
    clr = dense_clr(x, features)
    inside = [i for i, f in enumerate(features) if ("one", f) in got]
    scores = {r.sample_id: r.score for r in guilds.guild_scores(a.samples, a.abundance, a.features, members).collect() if r.guild == "one"}
    assert [scores[s] for s in meta.sample_id] == pytest.approx(list(clr[:, inside].mean(axis=1)))
    assert {r.guild for r in guilds.guild_scores(a.samples, a.abundance, a.features, members).collect()} == {"one"}
