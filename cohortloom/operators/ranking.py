"""Exact ranks, quantiles and rank statistics that never sort a group in one task.

A group (feature, cohort, replicate, or the whole table) may hold most of the
rows.  Every operator here cuts a group into value buckets.  The bucket is a
monotone function of the value alone, so bucket totals plus an in-bucket window
give the exact running total of the whole group, and the only rows a group
brings together are its bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_two_sided, ratio
from ..session import settle

BUCKETS_PER_OCTAVE = 64
_LAST_BUCKET = 1 << 40  # of values that have no place in the order


def order_bucket(value: Column) -> Column:
    """Monotone log-linear bucket number of a finite double."""
    size = F.abs(value.cast("double"))
    octave = F.floor(F.log2(size))
    step = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * BUCKETS_PER_OCTAVE)
    code = (octave + 1100) * BUCKETS_PER_OCTAVE + step
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value.cast("double")) * code).cast("bigint")


def draw_bucket(value: Column) -> Column:
    """One of 64 equal ranges of a uniform 60-bit draw."""
    return F.shiftright(value, 54)


def _bucket_offsets(rows: DataFrame, keys: list[str], measures: Sequence[str]) -> DataFrame:
    totals = rows.groupBy(*keys, "_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in measures])


def running_totals(df: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]) -> DataFrame:
    """One row per distinct value with the measures, their totals over smaller
    values (``<m>_below``) and their group totals (``<m>_total``)."""
    keys = list(keys)
    distinct = (df.filter(F.col(value).isNotNull())
                .groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
                .withColumn("_bucket", F.coalesce(order_bucket(F.col(value)), F.lit(0))))
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = distinct.join(_bucket_offsets(distinct, keys, measures), [*keys, "_bucket"])
    for m in measures:
        joined = joined.withColumn(
            f"{m}_below", F.col(f"_{m}_before") + F.coalesce(F.sum(m).over(within), F.lit(0)))
    return joined.select(*keys, value, *measures, *[f"{m}_below" for m in measures],
                         *[f"{m}_total" for m in measures])


def row_numbers(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "row_number",
                descending: bool = False) -> DataFrame:
    """Exact ``row_number`` by (value, tie) inside each group, all rows kept.

    A bigint ``value`` is taken as a keyed draw.  Order by a draw where many rows
    may be equal otherwise.  NULL and NaN come last, in either direction.
    """
    keys = list(keys)
    if df.schema[value].dataType.simpleString() == "bigint" and not descending:
        bucket = draw_bucket(F.col(value))
    else:
        number = F.col(value).cast("double")
        bucket = order_bucket(F.when(~F.isnan(number), -number if descending else number))
    rows = df.withColumn("_one", F.lit(1)).withColumn("_bucket", F.coalesce(bucket, F.lit(_LAST_BUCKET)))
    missing = F.col("_bucket") == _LAST_BUCKET
    ordered = F.when(~missing, F.col(value))
    within = Window.partitionBy(*keys, "_bucket").orderBy(
        ordered.desc() if descending else ordered.asc(), F.col(tie).asc())
    # merged, as the window needs the rows dealt by bucket anyway: Spark takes rows exploded per draw for as few as they
    # were before, and would send them all to the driver as the small side of the join
    offsets = _bucket_offsets(rows, keys, ["_one"]).drop("_one_total").hint("merge")
    return (rows.join(offsets, [*keys, "_bucket"])
            .withColumn(name, (F.col("__one_before") + F.row_number().over(within)).cast("bigint"))
            .drop("_bucket", "_one", "__one_before"))


def ranked_with_ties(df: DataFrame, value: str, tie_draw: str, name: str) -> DataFrame:
    """Rank 1..n of a whole table by falling value; equal values, however many,
    follow their keyed draw, so a large tie is cut into buckets as well."""
    base = settle(df.withColumn("_all", F.lit(0)))
    ahead = (running_totals(base.withColumn("_n", F.lit(1)).withColumn("_neg", -F.col(value)),
                            ["_all"], "_neg", ["_n"])
             .select((-F.col("_neg")).alias(value), F.col("_n_below")))
    inside = row_numbers(base, [value], tie_draw, tie_draw, "_inside")
    return (inside.join(ahead, value)
            .withColumn(name, (F.col("_n_below") + F.col("_inside")).cast("bigint"))
            .drop("_all", "_n_below", "_inside"))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
                      weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group: columns ``q0, q1, ...``.

    Only the buckets that hold a wanted order statistic are read again.
    ``weight`` is a repeat count, so an implicit zero enters as one row.
    """
    keys = list(keys)
    count = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    distinct = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(count.cast("bigint").alias("_c"))
                .filter("_c > 0").withColumn("_bucket", F.coalesce(order_bucket(F.col(value)), F.lit(0))))
    offsets = _bucket_offsets(distinct, keys, ["_c"])
    wanted = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("_c_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            wanted.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                                   rank.cast("bigint").alias("rank"),
                                   (position - F.floor(position)).alias("part")))
    following = Window.partitionBy(*keys).orderBy("_bucket")
    targets = (offsets
               .withColumn("_after", F.coalesce(F.lead("__c_before").over(following), F.col("_c_total")))
               .withColumn("_w", F.explode(F.array(*wanted)))
               .filter((F.col("_w.rank") >= F.col("__c_before")) & (F.col("_w.rank") < F.col("_after")))
               .groupBy(*keys, "_bucket", "__c_before").agg(F.collect_list("_w").alias("_ws")))
    within = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    hits = (distinct.join(targets, [*keys, "_bucket"])
            .withColumn("_start", F.col("__c_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
            .withColumn("_w", F.explode("_ws"))
            .filter((F.col("_w.rank") >= F.col("_start")) & (F.col("_w.rank") < F.col("_start") + F.col("_c"))))
    columns = []
    for i in range(len(probabilities)):
        at = F.col("_w.i") == i
        low = F.max(F.when(at & (F.col("_w.side") == "lo"), F.col(value)))
        high = F.max(F.when(at & (F.col("_w.side") == "hi"), F.col(value)))
        part = F.max(F.when(at, F.col("_w.part")))
        columns.append((low + (high - low) * part).alias(f"q{i}"))
    return hits.groupBy(*keys).agg(*columns)


def bh_adjust(df: DataFrame, p: str, q: str, family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q values inside each family; NULL p stays NULL.

    q of a p value is the smallest p'·n/rank(p') over p' >= p, clipped to [0, 1].
    """
    keys = ["_family", *family]
    # untested rows are spread over negative buckets, which no p value uses
    untested = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1024))
    base = settle(df.withColumn("_family", F.lit(0))
                  .withColumn("_bucket", F.coalesce(order_bucket(F.col(p)), untested))
                  .withColumn("_one", F.lit(1)))
    tested = base.filter(F.col(p).isNotNull()).select(*keys, "_bucket", "_one", p)
    upto = Window.partitionBy(*keys, "_bucket").orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = _bucket_offsets(tested, keys, ["_one"])
    rest = [c for c in base.columns if c not in (*keys, "_bucket", "_one")]
    scaled = (base.join(offsets, [*keys, "_bucket"], "left")
              .withColumn("_ratio", F.when(
                  F.col(p).isNotNull(),
                  F.col(p) * F.col("_one_total") / (F.col("__one_before") + F.sum("_one").over(upto)))))
    later = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    suffix = (scaled.filter(F.col("_ratio").isNotNull()).groupBy(*keys, "_bucket").agg(F.min("_ratio").alias("_m"))
              .withColumn("_later", F.min("_m").over(later)).drop("_m"))
    above = Window.partitionBy(*keys, "_bucket").orderBy(F.col(p).desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (scaled.join(suffix, [*keys, "_bucket"], "left")
            .withColumn(q, F.when(F.col(p).isNotNull(), F.least(
                F.min("_ratio").over(above), F.coalesce("_later", F.lit(1.0)), F.lit(1.0))))
            .select(*[k for k in keys if k != "_family"], *rest, q))


def class_rank_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str,
                       weight: str | None = None) -> DataFrame:
    """AUROC (ties count one half) and average precision per group.

    Both are NULL where a group has one class only.  ``weight`` is a repeat
    count, as in a bootstrap resample.
    """
    keys = list(keys)
    unit = F.col(weight) if weight else F.lit(1)
    marked = df.select(*keys, score,
                       F.when(F.col(label) == 1, unit).otherwise(0).cast("bigint").alias("pos"),
                       F.when(F.col(label) == 0, unit).otherwise(0).cast("bigint").alias("neg"))
    steps = running_totals(marked, keys, score, ["pos", "neg"])
    at_least_pos = (F.col("pos_total") - F.col("pos_below")).cast("double")
    at_least_neg = (F.col("neg_total") - F.col("neg_below")).cast("double")
    wins = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2)
    gain = F.col("pos").cast("double") * ratio(at_least_pos, at_least_pos + at_least_neg)
    summed = steps.groupBy(*keys).agg(
        F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
        F.sum(wins).alias("_wins"), F.sum(gain).alias("_gain"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return summed.select(
        *keys, "n_pos", "n_neg",
        F.when(both, F.col("_wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc"),
        F.when(both, F.col("_gain") / F.col("n_pos")).alias("average_precision"))


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, case: str, control: str) -> DataFrame:
    """Two-sided Mann-Whitney U of the case group with tie and continuity correction.

    ``case`` and ``control`` are the repeat counts of a row in the two groups.
    """
    keys = list(keys)
    steps = running_totals(
        df.select(*keys, value, F.col(case).cast("bigint").alias("pos"), F.col(control).cast("bigint").alias("neg")),
        keys, value, ["pos", "neg"])
    tie = (F.col("pos") + F.col("neg")).cast("double")
    out = steps.groupBy(*keys).agg(
        F.max("pos_total").cast("double").alias("_n1"), F.max("neg_total").cast("double").alias("_n0"),
        F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2)).alias("mannwhitney_u"),
        F.sum(tie * tie * tie - tie).alias("_ties"))
    n, pairs = F.col("_n1") + F.col("_n0"), F.col("_n1") * F.col("_n0")
    spread = F.sqrt(pairs / 12 * (n + 1 - ratio(F.col("_ties"), n * (n - 1))))
    larger = F.greatest(F.col("mannwhitney_u"), pairs - F.col("mannwhitney_u"))
    return (out.withColumn("_z", F.when(pairs > 0, ratio(larger - pairs / 2 - 0.5, spread)))
            .withColumn("mannwhitney_u", F.when(pairs > 0, F.col("mannwhitney_u")))
            # a value below the centre after the correction means p = 1
            .withColumn("pvalue", F.when(F.col("_z") <= 0, F.lit(1.0)).otherwise(normal_two_sided("_z")))
            .select(*keys, "mannwhitney_u", "pvalue"))
