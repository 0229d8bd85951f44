import numpy as np
import pytest
from planted import auroc, average_precision, bh
from pyspark.sql import functions as F

from cohortloom.functions.draws import draw
from cohortloom.operators import ranking


def test_order_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    values = sorted([0.0, 1e-300, 1.0, 2.0, 4.0, 8.0, -1.0, -8.0, *rng.normal(0, 100, 300), *np.exp(rng.normal(0, 20, 300)),
                     *[2.0 ** k for k in range(-40, 40)], *[np.nextafter(2.0 ** k, 0) for k in range(-40, 40)]])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", ranking.order_bucket(F.col("v")).alias("b"))
    got = [r.b for r in sorted(rows.collect(), key=lambda r: r.v)]
    assert got == sorted(got)


def test_bh_matches_definition_with_ties_nulls_and_families(spark):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.random(60), [0.02] * 5, [1.0, 1e-12]]).round(4)
    rows = [("x", i, float(v)) for i, v in enumerate(p)] + [("x", 900, None), ("y", 0, 0.04), ("y", 1, 0.03)]
    out = ranking.bh_adjust(spark.createDataFrame(rows, "fam string, i int, p double"), "p", "q", ["fam"]).collect()
    got = {(r.fam, r.i): r.q for r in out}
    assert len(out) == len(rows) and got[("x", 900)] is None
    assert [got[("x", i)] for i in range(len(p))] == pytest.approx(list(bh(p)))
    assert [got[("y", i)] for i in (0, 1)] == pytest.approx([0.04, 0.04])


def test_bh_replays_published_pairs(spark):
    """Published p and q of three panels under one exclusion."""
    p = [5.716939123315892e-15, 7.907260204766005e-08, 0.0422893949293557]
    q = [1.7150817369947674e-14, 1.1860890307149009e-07, 0.0422893949293557]
    out = ranking.bh_adjust(spark.createDataFrame([(v,) for v in p], "p double"), "p", "q").orderBy("p").collect()
    assert [r.q for r in out] == pytest.approx(q)


def test_class_metrics_match_pair_counting(spark):
    rng = np.random.default_rng(3)
    rows, expect = [], {}
    for key in ("a", "b", "one"):
        label = (rng.random(40) < 0.4).astype(int) if key != "one" else np.ones(40, int)
        score = rng.normal(0, 1, 40).round(1)
        rows += [(key, float(s), int(v)) for s, v in zip(score, label)]
        expect[key] = (auroc(label, score), average_precision(label, score)) if key != "one" else (None, None)
    out = ranking.class_rank_metrics(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s", "y").collect()
    for r in out:
        assert (r.auroc, r.average_precision) == (pytest.approx(expect[r.k]) if r.k != "one" else (None, None))


def test_quantiles_match_numpy_with_weighted_zeros(spark):
    rng = np.random.default_rng(4)
    rows, expect = [], {}
    for key, zeros in (("a", 0), ("b", 7), ("c", 40)):
        values = rng.gamma(1, 3, 21)
        rows += [(key, float(v), 1) for v in values] + ([(key, 0.0, zeros)] if zeros else [])
        expect[key] = np.quantile(np.concatenate([values, np.zeros(zeros)]), [0.0, 0.25, 0.5, 0.975, 1.0])
    out = ranking.grouped_quantiles(spark.createDataFrame(rows, "k string, v double, w int"), ["k"], "v",
                                    [0.0, 0.25, 0.5, 0.975, 1.0], "w").collect()
    for r in out:
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(expect[r.k]))


def test_row_numbers_and_ties(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).cast("double").alias("v"),
                                   draw(1, "t", F.col("id")).alias("d"))
    out = ranking.row_numbers(rows, ["g"], "v", "id", descending=True).collect()
    for g in range(3):
        mine = sorted((r for r in out if r.g == g), key=lambda r: r.row_number)
        assert [r.row_number for r in mine] == list(range(1, len(mine) + 1))
        assert [(-r.v, r.id) for r in mine] == sorted((-r.v, r.id) for r in mine)
    ranked = ranking.ranked_with_ties(rows, "v", "d", "rank").collect()
    ranked.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 501))
    assert [(-r.v, r.d) for r in ranked] == sorted((-r.v, r.d) for r in ranked)


def test_mann_whitney_against_direct_formula(spark):
    case, control = [0.0, 1.0, 2.0, 2.0, 5.0], [0.0, 0.0, 1.0, 3.0]
    rows = [("f", v, 1, 0) for v in case] + [("f", v, 0, 1) for v in control]
    out = ranking.mann_whitney(spark.createDataFrame(rows, "f string, v double, c int, k int"), ["f"], "v", "c", "k").first()
    u = sum((a > b) + (a == b) / 2 for a in case for b in control)
    ties = sum(t ** 3 - t for t in (3, 2, 2, 1, 1))
    sd = np.sqrt(20 / 12 * (10 - ties / 72))
    from math import erfc
    assert out.mannwhitney_u == u
    assert out.pvalue == pytest.approx(erfc((max(u, 20 - u) - 10 - 0.5) / sd / np.sqrt(2)))
