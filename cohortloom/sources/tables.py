"""Reading inputs, writing results, and the checks around both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import safe_number


class MissingInput(Exception):
    """An input table is absent or empty."""


def _read_text(spark: SparkSession, path: str, separator: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", separator).option("nullValue", "")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    # a byte-order mark belongs to the file, not to the first column name
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})


def read_tsv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             partitions: int | None = None) -> DataFrame:
    """A TSV with header, plain or gzip.

    A gzip file is read by one task; ``partitions`` spreads its rows for the
    steps that follow.
    """
    df = _read_text(spark, path, "\t", schema)
    return df.repartition(partitions) if partitions else df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return _read_text(spark, path, ",", schema)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_wide_matrix(spark: SparkSession, path: str, key: str, name: str = "sample_id",
                     feature: str = "feature") -> DataFrame:
    """A features x samples TSV as the sparse long table (feature, sample, value > 0).

    Lines are split where they are read and their cells matched to the header by
    place, so neither the plan nor a parser limit depends on the number of samples.
    Cells that are no finite positive number are absent.  Every part file starts
    with the header.
    """
    lines = spark.read.text(path)
    first = lines.first()
    header = first["value"].lstrip("\ufeff") if first else key
    names = [n.strip('"') for n in header.split("\t")]
    at = names.index(key)
    plain = lambda cell: F.regexp_replace(cell, '^"(.*)"$', "$1")
    cells = (lines.filter(F.ltrim("value", F.lit("\ufeff")) != F.lit(header))
             .select(F.split("value", "\t", -1).alias("_cells"))
             .select(plain(F.get("_cells", F.lit(at))).alias(feature), F.posexplode("_cells").alias("_at", "_cell"))
             .filter(F.col("_at") != at))
    value = safe_number(plain(F.col("_cell")))
    return (cells.select(feature, plain(F.get(F.split(F.lit(header), "\t", -1), F.col("_at"))).alias(name), value.alias("value"))
            .filter("value > 0"))


def required(df_or_path, spark: SparkSession | None = None, label: str = "input") -> DataFrame:
    """The table, or ``MissingInput`` if it cannot be read or holds no row."""
    try:
        df = spark.read.parquet(df_or_path) if isinstance(df_or_path, str) else df_or_path
        empty = df.isEmpty()
    except AnalysisException as error:
        raise MissingInput(f"{label} cannot be read") from error
    if empty:
        raise MissingInput(f"{label} is empty")
    return df


def write_tsv(df: DataFrame, path: str, gzip: bool = False) -> str:
    writer = df.write.mode("overwrite").option("header", True).option("sep", "\t")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_bundle(tables: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Several named tables under one folder, a parquet data set each."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def write_manifest(entries: Mapping[str, object], spark: SparkSession, path: str) -> str:
    rows = [(k, str(v)) for k, v in entries.items()]
    spark.createDataFrame(rows, "key string, value string").write.mode("overwrite").json(path)
    return path


def table_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and status of every named table; one job for all."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count",
            F.when(F.col("row_count") > 0, "READY").otherwise("EMPTY").alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def qc_ledger(samples: DataFrame, abundance: DataFrame, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Input checks as (check, status, value) text rows."""
    s = samples.agg(
        F.count(F.lit(1)).alias("metadata_rows"), F.countDistinct("sample_id").alias("metadata_samples"),
        F.count_if(F.col("condition") == labels[1]).alias("case_rows"),
        F.count_if(F.col("condition") == labels[0]).alias("control_rows"),
        F.count_if(~F.coalesce(F.col("condition").isin(*labels), F.lit(False))).alias("foreign_labels"),
        F.countDistinct("cohort").alias("cohorts"))
    x = abundance.agg(F.countDistinct("feature").alias("matrix_features"), F.countDistinct("sample_id").alias("matrix_samples"),
                      F.count_if(F.col("value") < 0).alias("negative_values"))
    strangers = abundance.select("sample_id").distinct().join(samples.select("sample_id"), "sample_id", "left_anti").agg(
        F.count(F.lit(1)).alias("samples_without_metadata"))
    zero_expected = ("foreign_labels", "negative_values", "samples_without_metadata")
    parts = []
    for one in (s, x, strangers):
        names = one.columns
        texts = one.select(*[F.col(c).cast("string").alias(c) for c in names])
        parts.append(texts.unpivot([], names, "check_name", "value"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    failed = F.col("check_name").isin(*zero_expected) & (F.col("value") != "0")
    return out.select("check_name", F.when(failed, "FAIL").otherwise("PASS").alias("status"), "value")


def completeness(samples: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Non-missing count, share and distinct values of each covariate."""
    rows = samples.select(*[F.col(c).cast("string").alias(c) for c in covariates]).unpivot(
        [], list(covariates), "covariate", "value")
    return rows.groupBy("covariate").agg(
        F.count("value").alias("non_missing"), F.count(F.lit(1)).alias("total"),
        (F.count("value") / F.count(F.lit(1))).alias("non_missing_fraction"),
        F.countDistinct("value").alias("distinct_values"))
