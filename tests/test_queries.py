"""Registered queries against their SQL on the smallest given tables.

A few by default; COHORTLOOM_ALL_QUERIES=1 runs every one.
"""

import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SOME = ("feature_landscape", "clr_profile", "association_screen", "loco_screen", "fine_cohort_screen", "mannwhitney_screen",
        "dl_random_effects", "auroc_by_cohort", "first_per_key", "registry_upsert", "lineage_ranks", "cohort_characteristics")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("COHORTLOOM_ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    return float(value) + 0.0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=str)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()), key=str)
    assert got == want


def test_every_oracle_has_its_query_and_the_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
