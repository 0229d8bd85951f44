import pytest

from cohortloom.operators import relational
from cohortloom.session import settle, spread
from cohortloom.sources import tables


def test_tsv_bom_gzip_and_wide_matrix(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("\ufefftaxon\ts.1\ts2\nf1\t0\t1.5\nf2\tx\t2\n", encoding="utf-8")
    assert tables.read_tsv(spark, str(path)).columns[0] == "taxon"
    plain = tmp_path / "w.tsv"
    plain.write_text("taxon\ts.1\ts2\nf1\t0\t1.5\nf2\tx\t2\n")
    got = {(r.feature, r.sample_id): r.value for r in tables.read_wide_matrix(spark, str(plain), "taxon").collect()}
    assert got == {("f1", "s2"): 1.5, ("f2", "s2"): 2.0}
    out = tables.write_tsv(spark.range(5).selectExpr("id", "id * 2 AS v"), str(tmp_path / "o"), gzip=True)
    assert tables.read_tsv(spark, out, "id long, v long", partitions=3).count() == 5


def test_required_input(spark, tmp_path):
    with pytest.raises(tables.MissingInput):
        tables.required(str(tmp_path / "absent"), spark)
    with pytest.raises(tables.MissingInput):
        tables.required(spark.range(0))
    assert tables.required(spark.range(2)).count() == 2


def test_upsert_republish_and_guards(spark):
    old = spark.createDataFrame([("A", "x"), ("B", "y")], "module_id string, status string")
    new = spark.createDataFrame([("B", "z"), ("C", "w")], "module_id string, status string")
    assert {tuple(r) for r in relational.upsert(old, new, "module_id").collect()} == {("A", "x"), ("B", "z"), ("C", "w")}
    rows = spark.createDataFrame([("random29_a", "old label"), ("keep", "old label here"), (None, "old label")], "kind string, note string")
    got = relational.republish(rows, {"note": "text"}, {"old label": "new"}, [("here", "there")], ("kind", "random29")).collect()
    assert {tuple(r) for r in got} == {("keep", "old label there"), (None, "new")}
    with pytest.raises(ValueError):
        relational.require_empty(relational.foreign_labels(old, "status", ["x"]), "labels")
    relational.require_empty(relational.foreign_labels(old, "status", ["x", "y"]), "labels")
    mixed = spark.createDataFrame([(1, "a", None), (1, "b", None)], "c int, v string, n string")
    assert relational.varying_columns(mixed, ["c", "v", "n"]) == ["v"] and relational.filled_columns(mixed, ["c", "v", "n"]) == ["c", "v"]


def test_settle_and_spread_keep_rows(spark):
    rows = settle(spread(spark.range(1000).groupBy("id").count(), "id"))
    assert rows.count() == 1000 and len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_ledger_flags_negative_and_unknown_samples(spark):
    samples = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 7)], "sample_id long, cohort string, condition int")
    values = spark.createDataFrame([(1, "f", 1.0), (9, "f", -1.0)], "sample_id long, feature string, value double")
    got = {r.check_name: (r.status, r.value) for r in tables.qc_ledger(samples, values).collect()}
    assert got["foreign_labels"] == ("FAIL", "1") and got["negative_values"] == ("FAIL", "1")
    assert got["samples_without_metadata"] == ("FAIL", "1") and got["metadata_rows"] == ("PASS", "3")
