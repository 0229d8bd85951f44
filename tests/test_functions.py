import math

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import lineage, text
from cohortloom.functions.draws import draw
from cohortloom.functions.stats import chi2_upper_tail, direction, normal_two_sided, signed_rank_exact


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 1e-6, 0.3, 0.67, 0.68, 1.0, 1.96, 3.2, 5.65, 5.66, 8.0, 20.0, 37.0, -2.5]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_two_sided("z").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-11)
    assert spark.createDataFrame([(None,)], "z double").select(normal_two_sided("z")).first()[0] is None


def test_chi2_five_percent_points(spark):
    points = [(3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (18.307038, 10), (19.675138, 11)]
    rows = spark.createDataFrame(points, "q double, k int").select(chi2_upper_tail("q", "k").alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx([0.05] * len(points), abs=1e-6)
    assert spark.createDataFrame([(None, None)], "q double, k int").select(chi2_upper_tail("q", "k")).first()[0] is None


def test_signed_rank_exact_small_cases(spark):
    # all five differences positive: 2 / 2^5; rank sum 8 of 15 is central
    rows = spark.createDataFrame([(15.0, 5), (8.0, 5), (0.0, 3)], "w double, n int").select(
        signed_rank_exact("w", "n").alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx([2 / 32, 1.0, 0.25])


def test_draws_are_pure_and_published(spark):
    first = {r.id: r.d for r in spark.range(50).select("id", draw(1, "x", F.col("id")).alias("d")).collect()}
    second = {r.id: r.d for r in spark.range(50).repartition(7).select("id", draw(1, "x", F.col("id")).alias("d")).collect()}
    assert first == second and len(set(first.values())) == 50 and max(first.values()) < 2 ** 60


def test_lineage_variants(spark):
    names = ["k__B|g__Aa|s__Aa_bc", "k__B;g__Aa;s__Aa_bc", "plain name", "k__B|g__X|s__a__b"]
    f = F.col("t")
    rows = spark.createDataFrame([(n,) for n in names], "t string").select(
        lineage.genus(f), lineage.species(f), lineage.species(f, "lineage"), lineage.species_tail(f),
        lineage.genus_or_first_word(f), lineage.mapped_rank(f, "s", True), lineage.mapped_rank(f, "g")).collect()
    assert tuple(rows[0]) == ("Aa", "Aa bc", "Aa bc", "Aa bc", "Aa", "Aa bc", "Aa")
    assert tuple(rows[1])[:3] == ("Aa", "Aa bc", "Aa bc")
    assert tuple(rows[2]) == ("", "", "plain name", "plain name", "plain", "plain name", "")
    assert rows[3][5] == "a  b"


def test_text_forms(spark):
    one = spark.createDataFrame([(0.00012, 0.0456, None)], "a double, b double, c double")
    got = one.select(text.p_text(F.col("a")), text.p_text(F.col("b"), 4, True), text.fixed(F.col("c")),
                     text.percent_text(F.col("b")), text.yes_no(F.lit("GENUS_MATCH")), text.yes_no(F.lit(False)),
                     text.dashed_ranges(F.lit("61-70 a-b")), text.shortened(F.lit("one two three four"), 12),
                     text.shortened(F.lit("short"), 12), text.multiplier_of(F.lit("minimum_positive_x_0.25")),
                     *text.interval_numbers(F.lit("0.752 (0.70, 0.81)"))).first()
    assert tuple(got) == ("1.20e-04", "0.0456", "NA", "4.6%", "yes", "no", "61–70 a-b", "one two...", "short", 0.25,
                          0.752, 0.70, 0.81)


def test_direction_labels(spark):
    rows = spark.createDataFrame([(1.0,), (-1.0,), (0.0,), (None,)], "v double")
    assert [r[0] for r in rows.select(direction(F.col("v"))).collect()] == ["CRC_higher", "control_higher", "zero", None]
    assert rows.select(direction(F.col("v"), "CRC_higher")).collect()[2][0] == "CRC_higher"


def test_decimals_follow_the_binary_value(spark):
    values = [4508.15, 0.125, 0.375, 2.5, -0.0625, 1234.5678, 0.05, 99.95, 0.0004, -3.14159, 7.0]
    for digits in (0, 1, 3):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.decimals(F.col("v"), digits).alias("t")).collect()
        for r in rows:
            assert float(r.t) == float(f"{r.v:.{digits}f}") and r.t.lstrip("-") == f"{abs(r.v):.{digits}f}"
