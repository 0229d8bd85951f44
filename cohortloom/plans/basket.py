"""Cohort data sets derived from the given tables.

Baskets: a sample is a customer with lineitems, a feature is a part lineage,
its value the share (percent) of the customer's quantity, the cohort the
region, and the condition a promo-heavy basket.  "fine" baskets name parts by
type and brand (sparse), "coarse" ones by type and noun (dense).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import partitions_for, settle, settle_by

PREVALENCE = 0.20
MIN_COHORTS = 3


@dataclass(frozen=True)
class CohortData:
    samples: DataFrame
    abundance: DataFrame


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lineage_of(part_type: str, label: str) -> Column:
    kind = F.col(part_type)
    return F.concat(F.lit("k__part|p__all|f__"), kind, F.lit("|g__"), kind, F.lit("|s__"), kind, F.lit("_"),
                    F.col(label))


def part_label(data: str) -> Column:
    if data == "coarse":
        return F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))


_BUILT: dict[tuple[str, str, str], CohortData] = {}


def baskets(spark: SparkSession, folder: str, data: str = "fine") -> CohortData:
    """The basket tables, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, data)
    if key not in _BUILT:
        n = partitions_for(spark, table(spark, folder, "lineitem").count())
        raw = derive_baskets(spark, folder, data, n)
        _BUILT[key] = CohortData(settle_by(raw.samples, "sample_id", n), settle_by(raw.abundance, "sample_id", n))
    return _BUILT[key]


def forget() -> None:
    """Drop the written data sets, so that the next query derives them again."""
    _BUILT.clear()


def derive_baskets(spark: SparkSession, folder: str, data: str, n: int) -> CohortData:
    """The tables dealt in ``n`` partitions, whose number follows the rows and not the session."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("sample_id"), "o_totalprice", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, folder, "part").select("p_partkey", "p_type", part_label(data).alias("p_label"))
    # most (sample, part kind) pairs have one line, so forming totals before the rows move would only hold them in memory;
    # a customer with many lines is spread over its part kinds
    bought = (lines.repartition(n, "l_orderkey")
              .join(orders.select("o_orderkey", "sample_id").repartition(n, "o_orderkey").hint("merge"),
                    F.col("l_orderkey") == F.col("o_orderkey"))
              .join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .select("sample_id", "p_type", "p_label", "l_quantity"))
    quantity = (bought.repartition(n, "sample_id", "p_type", "p_label")
                .groupBy("sample_id", "p_type", "p_label").agg(F.sum("l_quantity").alias("quantity")))
    quantity = settle_by(quantity, "sample_id", n)
    totals = quantity.groupBy("sample_id").agg(
        F.sum("quantity").alias("total"),
        F.sum(F.when(F.col("p_type") == "PROMO", F.col("quantity")).otherwise(0.0)).alias("promo"))
    abundance = quantity.join(totals.hint("merge"), "sample_id").select(
        "sample_id", lineage_of("p_type", "p_label").alias("feature"),
        (100 * F.col("quantity") / F.col("total")).alias("value"))
    nations = (table(spark, folder, "nation")
               .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
               .select("n_nationkey", F.col("n_name").alias("fine_cohort"), F.col("r_name").alias("cohort")))
    customers = (table(spark, folder, "customer")
                 .select(F.col("c_custkey").alias("sample_id"), "c_nationkey", "c_acctbal", "c_mktsegment")
                 .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    per_customer = orders.repartition(n, "sample_id").groupBy("sample_id").agg(
        F.avg("o_totalprice").alias("bmi"), F.min_by("o_orderpriority", "o_orderkey").alias("gender"))
    samples = (totals.join(customers.repartition(n, "sample_id").hint("merge"), "sample_id")
               .join(per_customer.hint("merge"), "sample_id").select(
        "sample_id", "cohort", "fine_cohort",
        F.when(F.col("promo") * 6 >= F.col("total"), 1).otherwise(0).alias("condition"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("age"), "bmi", "gender",
        F.col("fine_cohort").alias("country"), F.col("c_mktsegment").alias("platform"),
        F.col("c_acctbal").alias("score")))
    return CohortData(samples, abundance)


def token_shares(spark: SparkSession, folder: str) -> CohortData:
    """Labelled documents as samples and the share (percent) of each token."""
    key = (spark.sparkContext.applicationId, folder, "tokens")
    if key not in _BUILT:
        labelled = table(spark, folder, "documents").select("doc_id", "text", "lang").join(
            table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")
        counts = (labelled.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("cohort"),
                                  F.col("quality").alias("condition"),
                                  F.explode(F.split("text", "[ \n\t\r]+")).alias("feature"))
                  .filter("feature <> ''").groupBy("sample_id", "cohort", "condition", "feature")
                  .agg(F.count(F.lit(1)).alias("n")))
        counts = settle(counts)
        totals = counts.groupBy("sample_id", "cohort", "condition").agg(F.sum("n").alias("total"))
        abundance = counts.join(totals.select("sample_id", "total"), "sample_id").select(
            "sample_id", "feature", (F.lit(100.0) * F.col("n") / F.col("total")).alias("value"))
        _BUILT[key] = CohortData(settle(totals.drop("total")), settle(abundance))
    return _BUILT[key]
