"""Table upkeep: upserts, republishing, guards and column checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, followed by ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def republish(df: DataFrame, rename: Mapping[str, str] | None = None, relabel: Mapping[str, str] | None = None,
              replace_text: Sequence[tuple[str, str]] = (), drop_prefix: tuple[str, str] | None = None) -> DataFrame:
    """Rename columns, drop rows whose column starts with a prefix, relabel whole
    values and replace literal substrings in every text column."""
    out = df.withColumnsRenamed(dict(rename or {}))
    if drop_prefix:
        out = out.filter(~F.coalesce(F.startswith(drop_prefix[0], F.lit(drop_prefix[1])), F.lit(False)))
    texts = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
    if relabel and texts:
        out = out.replace(dict(relabel), subset=texts)
    for found, put in replace_text:
        out = out.withColumns({c: F.replace(F.col(c), F.lit(found), F.lit(put)) for c in texts})
    return out


def mark_long_text(df: DataFrame, column: str, marker: str, limit: int = 30000) -> DataFrame:
    """Cells over the limit are replaced by a marker."""
    return df.withColumn(column, F.when(F.length(column) > limit, marker).otherwise(F.col(column)))


def latest_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A lookup table: of several values per key the last by ``order`` wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def look_up(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key combination in the given order.

    A struct minimum keeps one row per key in every task before rows move.
    """
    keys = list(keys)
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    return df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*")


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, with the side that lacks them."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, key, "full_outer").filter("_l IS NULL OR _r IS NULL").select(
        key, F.when(F.col("_l").isNull(), "left").otherwise("right").alias("missing_in"))


def foreign_labels(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Labels outside the allowed set."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().filter(~F.col(column).isin(*allowed))


def require_empty(problems: DataFrame, message: str) -> None:
    """Stop with a message that names one problem row."""
    row = problems.first()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with more than one distinct value, NULL counting as a value."""
    facts = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns],
                   *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in columns], F.count(F.lit(1)).alias("n")).first()
    return [c for c in columns if facts[f"lo_{c}"] != facts[f"hi_{c}"] or 0 < facts[f"na_{c}"] < facts["n"]]


def filled_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without any NULL."""
    facts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if facts[c] == 0]


def by_order_list(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows with their place in an explicit order; values not listed are dropped."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.withColumn("place", place).filter("place > 0")


def keyed_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """A fixed sample of n rows for a plot overlay."""
    return df.withColumn("_d", draw(seed, "sample", F.col(key))).orderBy("_d", key).limit(n).drop("_d")


def count_by_value(df: DataFrame, column: str) -> DataFrame:
    """Value counts with a row for NULL."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def cohort_condition_pivot(samples: DataFrame) -> DataFrame:
    return (samples.groupBy("cohort").pivot("condition", [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
            .withColumnsRenamed({"0": "control", "1": "case"}))

