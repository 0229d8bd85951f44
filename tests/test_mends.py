"""Odd values and limits: NULL and NaN in ranks and readers, very wide files, folders, unfinished fits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.functions.text import safe_number
from cohortloom.operators import elasticnet, panels, resample
from cohortloom.operators.ranking import row_numbers
from cohortloom.plans import queries_evidence
from cohortloom.sources import tables


def test_null_and_nan_come_last_in_ranks(spark):
    df = spark.createDataFrame([(1, None), (2, -5.0), (3, 5.0), (4, 0.0), (5, math.nan)], "k int, v double").withColumn("g", F.lit(1))
    up = {r.k: r.row_number for r in row_numbers(df, ["g"], "v", "k").collect()}
    down = {r.k: r.row_number for r in row_numbers(df, ["g"], "v", "k", descending=True).collect()}
    assert up == {2: 1, 4: 2, 3: 3, 1: 4, 5: 5} and down == {3: 1, 4: 2, 2: 3, 1: 4, 5: 5}


def test_texts_that_are_no_finite_number_are_null(spark):
    df = spark.createDataFrame([(x,) for x in ("1.5", "NaN", "Infinity", "-inf", "x", None, "-2")], "t string")
    assert [r.n for r in df.select(safe_number(F.col("t")).alias("n")).collect()] == [1.5, None, None, None, None, None, -2.0]


def test_a_matrix_with_very_many_samples_is_read(spark, tmp_path):
    n = 21_000
    path = tmp_path / "wide.tsv"
    cells = ["0"] * n
    cells[0], cells[n - 1], cells[5], cells[6] = "2.5", "7", "NaN", ""
    path.write_text("﻿taxon\t" + "\t".join(f"s{i}" for i in range(n)) + "\nf1\t" + "\t".join(cells) + "\n")
    found = {(r.feature, r.sample_id): r.value for r in tables.read_wide_matrix(spark, str(path), "taxon").collect()}
    assert found == {("f1", "s0"): 2.5, ("f1", f"s{n - 1}"): 7.0}


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Conf:
        values = {"spark.master": "spark://somewhere"}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster())
    assert queries_evidence.scratch(spark, "a.tsv") != queries_evidence.scratch(spark, "a.tsv")


def test_a_fit_that_runs_out_of_rounds_says_so(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(int)
    rows = session.settle(spark.createDataFrame([(i, "c", int(y[i]), 0, x[i].tolist()) for i in range(80)],
                                                "sample_id bigint, cohort string, condition int, fold int, x array<double>"))
    model = elasticnet.Model(0, "p", 0, "own", "c", 0, (0, 1, 2))
    short, long = (elasticnet.fit_models(rows, [model], rounds=n) for n in (2, 40))
    assert all(f.converged for f in long) and not any(f.converged for f in short)


def test_quotas_of_many_targets_follow_all_of_them(spark):
    bins = spark.createDataFrame([("d", f"f{i:03d}", i / 200, i % 4) for i in range(200)], "design_id string, feature string, prevalence double, bin int")
    # 60 targets: by name the first 29 would come from the first names only
    targets = spark.createDataFrame([(f"f{i:03d}",) for i in range(0, 120, 4)] + [(f"f{i:03d}",) for i in range(121, 181, 4)]
                                    + [(f"f{i:03d}",) for i in range(122, 182, 4)], "feature string")
    found = panels.matched_random_panels(bins, targets, 3, 1, size=29).filter("from_bin = 1").groupBy("repeat_id", "bin").count().collect()
    assert {(r.repeat_id, r.bin): r["count"] for r in found} == {(k, b): n for k in (1, 2, 3) for b, n in {0: 15, 1: 7, 2: 7}.items()}


def test_performance_rows_have_the_accuracy_and_its_interval(spark):
    scored = [("a", i, int(i % 3 == 0), (i * 7 % 20 + 6 * (i % 3 == 0)) / 30) for i in range(30)]
    predictions = spark.createDataFrame(scored, "held_out string, sample_id int, condition int, probability double")
    folds = spark.createDataFrame([("a", 50, 30, 10, 20, "COMPUTED", 0.76543, 0.61234), ("b", 50, 0, 0, 0, "NO_TEST", None, None)],
                                  "held_out string, n_train int, n_test int, n_test_case int, n_test_control int, status string, "
                                  "auroc double, average_precision double")
    got = {r.held_out: r for r in queries_evidence.performance_rows(folds, predictions).collect()}
    want = resample.bootstrap_auroc(predictions, ["held_out"], "probability", "condition", queries_evidence.BOOT, queries_evidence.SEED).first()
    assert (got["a"].auroc, got["a"].average_precision) == (0.7654, 0.6123)
    assert abs(got["a"].ci_low - want.ci_low) < 1e-4 and abs(got["a"].ci_high - want.ci_high) < 1e-4
    assert got["a"].ci_low < got["a"].ci_high and got["a"].replicates_used == want.replicates_used
    assert got["b"].auroc is None and got["b"].ci_low is None and got["b"].replicates_used == 0
