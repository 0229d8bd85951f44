import hashlib

import numpy as np
import pyarrow as pa
import pytest
from planted import planted, tables
from pyspark.sql import functions as F

from cohortloom.functions.draws import draw_grid
from cohortloom.operators import linear, permutation, resample


def test_draw_grid_is_md5():
    heads, tails = ["", "1|label|7|", "1|label|70|", "é|" * 20, "x" * 53], ["3", "12", "ü", "y" * 9, ""]
    got = draw_grid(heads, tails)
    assert [[int(v) for v in row] for row in got] == [
        [int(hashlib.md5((h + t).encode()).hexdigest()[:15], 16) for t in tails] for h in heads]


def test_label_cuts_take_one_histogram(spark, monkeypatch):
    """Before, a cohort of some thousand samples was read once for every six bits of the cut's draw."""
    samples = spark.range(9000).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 8000, "a").otherwise("b").alias("cohort"),
                                       (F.col("id") % 3 == 0).cast("int").alias("condition"))
    calls, real = [], permutation._histograms
    monkeypatch.setattr(permutation, "_histograms", lambda *args: calls.append(1) or real(*args))
    cuts = permutation.label_cuts(samples, 8, 3)
    assert len(calls) == 1
    for cohort, keys in (("a", range(8000)), ("b", range(8000, 9000))):
        draws = np.sort(permutation.draws_of(3, 8)([str(k) for k in keys]), axis=0)
        low, shift, rank = cuts[cohort]
        for p in range(8):
            cut = draws[sum(k % 3 == 0 for k in keys) - 1, p]
            assert int(low[p]) <= cut < int(low[p]) + (1 << int(shift[p])) and (draws[:, p] < low[p]).sum() + rank[p] == sum(k % 3 == 0 for k in keys)


def test_label_cuts_outside_the_window(spark, monkeypatch):
    from cohortloom.plans.analysis import CohortAnalysis
    a = CohortAnalysis(*tables(spark, *planted()), 0.05, 2)
    want = {(r.sample_id, r.perm): r.label for r in permutation.permuted_labels(a.samples, 9, 3).collect()}
    monkeypatch.setattr(permutation, "WINDOW", -20.0)  # a window beside the cut: it is found all the same
    assert {(r.sample_id, r.perm): r.label for r in permutation.permuted_labels(a.samples, 9, 3).collect()} == want


def test_bootstrap_auroc_over_pieces(spark, monkeypatch):
    """Draws and scores cut into many pieces give what rows by rows give; before, a row was made for every draw."""
    monkeypatch.setattr(resample, "PIECE", 16)
    monkeypatch.setattr(resample, "TOGETHER", 7)
    rng = np.random.default_rng(4)
    rows = [(i, c, int(rng.random() < 0.4), None if i % 31 == 0 else float(rng.integers(0, 12)) if c == "ties" else float(rng.normal()))
            for i, c in enumerate(["ties"] * 90 + ["apart"] * 75 + ["few"] * 3)]
    scored = spark.createDataFrame(rows, "sample_id long, cohort string, condition int, score double")
    got = {r.cohort: r for r in resample.bootstrap_auroc(scored, ["cohort"], "score", "condition", 30, 5).collect()}

    def draw_of(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    for cohort in ("ties", "apart", "few"):
        mine = sorted((r for r in rows if r[1] == cohort), key=lambda r: (draw_of(5, "order", r[0]), r[0]))
        found = []
        for k in range(1, 31):
            drawn = [mine[draw_of(5, "bootstrap", cohort, k, j) % len(mine)] for j in range(1, len(mine) + 1)]
            pos, neg = ([r[3] for r in drawn if r[2] == g and r[3] is not None] for g in (1, 0))
            if pos and neg:
                found.append(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
        if found:
            assert got[cohort].replicates_used == len(found)
            assert (got[cohort].ci_low, got[cohort].ci_high) == pytest.approx(tuple(np.quantile(found, [0.025, 0.975])))
        else:
            assert cohort not in got


def exploded_under_broadcast(df):
    """Whether the plan that ran sent rows made by an explode to the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in plan]
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            under = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            if any("Generate" in below for below in plan[i:under]):
                return True
    return False


def test_rows_exploded_per_draw_are_not_broadcast(spark):
    """Spark sizes exploded rows as those before the explode; ranked by draw, they went to the driver as the small side."""
    samples = spark.range(2000).select(F.col("id").alias("sample_id"), (F.col("id") % 7).cast("double").alias("age"))
    moved = resample.permuted_column(samples, "age", 200, 1)
    assert len(moved.collect()) == 400_000
    assert not exploded_under_broadcast(moved)


def test_permuted_terms_are_not_broadcast(spark):
    samples = spark.range(2000).select(F.col("id").alias("sample_id"), F.lit("a").alias("cohort"), F.lit(1).alias("condition"),
                                       F.array(F.lit(1.0), F.col("id").cast("double")).alias("z"))
    moved = linear.permuted_terms(linear.Design(samples, ("const", "age_z"), ("const", "age")), "age", 200, 1, False)
    rows = moved.collect()
    assert not exploded_under_broadcast(moved)
    assert len(rows) == 2000 and all(sorted(r.zp[p] for r in rows) == list(range(2000)) for p in (0, 199))


def shuffled_rows(df):
    """Rows that the plan of a collected table wrote to shuffles."""
    seen, todo, total = set(), [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_permuted_column_moves_no_row_per_draw(spark, monkeypatch):
    """Before, every sample and permutation was a row in three shuffles; now pieces of the samples are copied for blocks of permutations."""
    monkeypatch.setattr(resample, "PIECE", 64)
    samples = spark.range(500).select(F.col("id").alias("sample_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("cohort"),
                                      F.when(F.col("id") % 5 > 0, F.col("id") * 1.5).alias("age"))
    moved = resample.permuted_column(samples, "age", 60, 7, ["sample_id", "cohort"])
    got = moved.collect()
    assert 0 < shuffled_rows(moved) < 60  # 8 pieces for each of 3 blocks of permutations

    def draw_of(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    values = [i * 1.5 if i % 5 else None for i in sorted(range(500), key=lambda i: draw_of(7, "order", i))]
    want = {(p, i): v for p in range(1, 61) for i, v in zip(sorted(range(500), key=lambda i: draw_of(7, "permute_age", p, i)), values)}
    assert {(r.perm, r.sample_id): r.value for r in got} == want and len(got) == len(want)
    assert all(r.cohort == f"c{r.sample_id % 3}" for r in got)


def test_equal_draws_are_ordered_by_id():
    ids = pa.array([30, 4, 200, 1])
    assert resample.order_of(np.array([5, 9, 5, 9], np.uint64), ids).tolist() == [0, 2, 3, 1]
    assert resample.order_of(np.array([5, 9, 5, 9], np.uint64), pa.array(["30", "4", "200", "1"])).tolist() == [2, 0, 3, 1]


def test_permuted_terms_of_many_pieces_follow_the_draws(spark):
    """Columns of a term move together, within cohorts or over all samples; before, a row was made for every sample and permutation."""
    rows = [(i, "ab"[i % 7 == 0], [1.0, float(i % 3 == 0), float(i % 3 == 1), i ** 0.5]) for i in range(400)]
    samples = spark.createDataFrame(rows, "sample_id long, cohort string, z array<double>").withColumn("condition", F.lit(1))
    design = linear.Design(samples, ("const", "kind_a", "kind_b", "age_z"), ("const", "kind", "kind", "age"))

    def draw_of(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    for term, within, columns in (("kind", False, slice(1, 3)), ("age", True, slice(3, 4))):
        got = {r.sample_id: r.zp for r in linear.permuted_terms(design, term, 40, 3, within).collect()}
        for group in ("a", "b") if within else ("ab",):
            mine = [i for i, cohort, _ in rows if cohort in group]
            own = [rows[i][2][columns] for i in sorted(mine, key=lambda i: draw_of(3, "order", i))]
            width = len(own[0])
            for p in (1, 28, 29, 40):
                for i, z in zip(sorted(mine, key=lambda i: draw_of(3, f"permute_{term}", p, i)), own):
                    assert got[i][(p - 1) * width:p * width] == z


def test_permutation_nulls_move_no_row_per_draw(spark):
    rng = np.random.default_rng(2)
    n, perms = 1500, 60
    z = np.column_stack([np.ones(n), rng.integers(0, 2, n), rng.normal(size=n)])
    x = rng.normal(size=(n, 4)) + z[:, 1:2]
    base = spark.createDataFrame([(i, "ab"[i % 2], 1, z[i].tolist(), x[i].tolist()) for i in range(n)],
                                 "sample_id long, cohort string, condition int, z array<double>, x array<double>")
    design = linear.Design(base.select("sample_id", "cohort", "condition", "z"), ("const", "condition", "age_z"), ("const", "condition", "age"))
    xz = z.T @ x
    shares = linear.VarianceShares(design, z.T @ z, xz @ xz.T, float((x ** 2).sum()), n)
    study = linear.PermutationStudy(shares, base.select("sample_id", "x"))
    null = study.nulls([("condition", ["age"], True), ("age", ["condition"], False), ("bmi", ["age"], False)], perms, 3)
    got = {(r.term, r.perm): r.pseudo_f for r in null.collect()}
    assert 0 < shuffled_rows(null) < 4000  # 1,500 profiles, and a few rows for each piece and block of permutations; 180,000 before
    assert len(got) == 3 * perms and all(got["bmi", p] is None for p in range(1, perms + 1))
    for term, given, own, within in (("condition", "age", 1, True), ("age", "condition", 2, False)):
        moved = {r.sample_id: r.zp for r in linear.permuted_terms(design, term, perms, 3, within).collect()}
        for p in (1, 30, 60):
            full = z.copy()
            full[:, own] = [moved[i][p - 1] for i in range(n)]

            def rss(d):
                return ((x - d @ np.linalg.lstsq(d, x, rcond=None)[0]) ** 2).sum()

            reduced = rss(np.delete(z, own, axis=1))
            assert got[term, p] == pytest.approx((reduced - rss(full)) / (rss(full) / (n - 3)), rel=1e-7)
    # with rows numbered before the profiles were made, nothing is joined again
    again = linear.PermutationStudy(shares, linear.ordered_rows(design, 3).select("sample_id", "z", "_k").join(base.select("sample_id", "x"), "sample_id"))
    assert {(r.term, r.perm): r.pseudo_f for r in again.nulls([("age", ["condition"], False)], perms, 3).collect()} == pytest.approx(
        {k: v for k, v in got.items() if k[0] == "age"}, rel=1e-9)
