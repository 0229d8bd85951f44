import importlib.util
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not Path(FOLDER).exists():
        pytest.skip("given tables not present")
    return FOLDER


@pytest.fixture(scope="session")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture
def rows(spark):
    """Documents from (doc_id, text, ...) tuples, with columns that clash with the operators' own."""
    def make(*found, schema="doc_id bigint, text string, source string"):
        width = len(schema.split(","))
        full = [tuple(list(r) + [None] * (width - len(r))) for r in found]
        from pyspark.sql import functions as F
        return (spark.createDataFrame(full, schema).repartition(3)
                .withColumn("n_words", F.lit("clash")).withColumn("base", F.lit(None).cast("int")).withColumn("salt", F.lit(1.5)))
    return make
