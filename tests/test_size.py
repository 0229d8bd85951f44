"""Plans that stay bounded as the tables grow."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.operators import elasticnet, linear, moments, transfer
from cohortloom.plans import basket, registry
from planted import planted, tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")
def test_partitions_of_the_baskets_follow_the_rows(spark, monkeypatch):
    """More rows mean more tasks, and joins by sample move nothing again."""
    basket.forget()
    registry.forget_analyses()
    monkeypatch.setattr(session, "ROWS_PER_TASK", 600)
    data = basket.baskets(spark, FOLDER, "coarse")
    lines = basket.table(spark, FOLDER, "lineitem").count()
    n = -(-lines // 600)
    assert n > 8
    counted = data.abundance.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k"))
    assert f"{n} out of {n}" in plan_of(counted) and "Exchange" not in plan_of(counted)
    joined = data.abundance.join(data.samples.hint("merge"), "sample_id")
    assert "Exchange" not in plan_of(joined)
    assert joined.count() == data.abundance.count() > 0
    basket.forget()
    registry.forget_analyses()


def test_configurations_copy_no_rows_before_they_move(spark):
    """One pass serves every configuration, with the moments each would have alone."""
    samples, abundance = tables(spark, *planted())
    names = [r[0] for r in abundance.select("feature").distinct().orderBy("feature").collect()]
    own = {"a": (names, 0.01), "b": (names[::2], 0.02), "c": (names[1:], 0.01)}
    features = spark.createDataFrame([(c, f) for c, (fs, _) in own.items() for f in fs], "config_id string, feature string")
    config = spark.createDataFrame([(c, p) for c, (_, p) in own.items()], "config_id string, pseudocount double")
    table = moments.clr_moments(samples, abundance, features, config=config)
    assert "hashpartitioning(config_id#" not in "".join(
        line for line in plan_of(table).splitlines() if "sample_id" in line)
    got = {(r.config_id, r.feature, r.cohort): r for r in table.collect()}
    want = {}
    for c, (fs, pc) in own.items():
        alone = moments.clr_moments(samples, abundance, spark.createDataFrame([(f,) for f in fs], "feature string"), pc=F.lit(pc))
        want |= {(c, r.feature, r.cohort): r for r in alone.collect()}
    assert got.keys() == want.keys()
    for key, r in want.items():
        for name in ("n1", "n0", "mean1", "mean0", "var1", "var0"):
            assert got[key][name] == pytest.approx(r[name], abs=1e-9), (key, name)


def test_given_folds_move_no_profiles(spark):
    """The arrays meet their folds before they are made."""
    rows = [(i, f"c{i % 2}", i // 2 % 2, [float(i % 5), float(i % 3)], 7) for i in range(40)]
    profiles = spark.createDataFrame(rows, "sample_id long, cohort string, condition int, x array<double>, fold int")
    assert {r.fold for r in transfer.TransferStudy(profiles, ["f", "g"]).rows.collect()} == {7}


def test_a_round_is_solved_however_many_samples_there_are():
    """Columns that add up to zero, as the CLR's do, with the sums of many samples."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(4000, 30))
    z = np.column_stack([np.ones(4000), z - z.mean(axis=1, keepdims=True)])
    y = z[:, 1:6] @ rng.normal(size=5) + rng.normal(size=4000)
    h, c = z.T @ z * 2000, z.T @ y * 2000
    b = elasticnet._next_weights(h, c, np.zeros(31), 1.0, 1.0)
    rest = c - h @ b
    assert abs(rest[0]) < 1e-3
    used = b[1:] != 0
    assert np.allclose(rest[1:][used], (b + np.sign(b))[1:][used], atol=1e-3) and np.all(np.abs(rest[1:][~used]) < 1.001)


def test_design_rows_meet_a_sample_once(spark, monkeypatch):
    """The non-zero rows of a sample are gathered before its design row joins them."""
    plans = []
    monkeypatch.setattr(linear, "settle", lambda df: plans.append(plan_of(df)) or session.settle(df))
    samples = spark.createDataFrame([(i, "ab"[i % 2], i // 2 % 2, float(i * i % 11)) for i in range(24)] + [(99, "a", 1, 3.0)],
                                    "sample_id long, cohort string, condition int, age double")
    rows = [(i, f"f{j}", 1.0 + (i * 7 + j * 5) % 9) for i in range(24) for j in range(4) if (i + j) % 3]
    abundance = spark.createDataFrame(rows, "sample_id long, feature string, value double")
    features = spark.createDataFrame([(f"f{j}",) for j in range(4)] + [("unseen",)], "feature string")
    got = {r.feature: r for r in linear.LinearScreens(samples, abundance, features).covariate_screen(
        linear.build_design(samples, ["age"], ["cohort"])).collect()}
    assert any("collect_list" in p and "MapInArrow" in p for p in plans)
    u = np.zeros((25, 5))
    for i, f, v in rows:
        u[i, int(f[1:])] = np.log1p(v / 0.5)
    clr, s = u - u.mean(axis=1, keepdims=True), samples.orderBy("sample_id").collect()
    age = np.array([r.age for r in s])
    z = np.column_stack([np.ones(25), [r.condition for r in s], (age - age.mean()) / age.std(ddof=1), [r.cohort == "b" for r in s]])
    inverse = np.linalg.inv(z.T @ z)
    slack = 1 - np.einsum("ij,jk,ik->i", z, inverse, z)
    for j, name in enumerate(["f0", "f1", "f2", "f3", "unseen"]):
        beta = inverse @ z.T @ clr[:, j]
        weighted = z * ((clr[:, j] - z @ beta) / slack)[:, None]
        assert got[name].coef == pytest.approx(beta[1], abs=1e-9)
        assert got[name].se == pytest.approx(np.sqrt((inverse @ weighted.T @ weighted @ inverse)[1, 1]), abs=1e-9)
