"""Temperature mixing of sources in column expressions.

Source token counts t are raised to an exponent a between 0 (all sources alike)
and 1 (as they are); a is bisected until a repetition limit or a target entropy
is met.  The weights become token budgets, and each source's budget is filled by
passes over its documents, every pass in a new order: a permutation drawn by
hash, cut into blocks of about BLOCK_DOCS documents whose token sums place them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw, draw_sql
from ..session import settle
from .rows import WORD, unused

MAX_REPEATS = 2.0
BLOCK_DOCS = 4096
SEED = 17
STEPS, BATCHES = 6, 5  # bisection steps looked at in one aggregation, and such aggregations


def tokens(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), tokens(F.col(text)).alias("tokens"))


def source_totals(docs: DataFrame) -> DataFrame:
    return settle(docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("total")))


def bisect_exponent(totals: DataFrame, max_repeats: float | None, entropy: float | None) -> float:
    """The smallest exponent whose most repeated source is passed at most ``max_repeats`` times as often as the
    least repeated one, or the largest whose weights have at least ``entropy`` (nats); 1 if nothing binds.

    Each aggregation evaluates the midpoints that the next STEPS bisections can
    come to; only these few rows reach the driver, however many sources there are.
    """
    low, high = 0.0, 1.0
    for _ in range(BATCHES):
        width = (high - low) / 2 ** STEPS
        grid = [low + width * i for i in range(2 ** STEPS + 1)]
        term = F.pow("total", F.col("a"))
        rows = (totals.filter(F.col("total") > 0).withColumn("a", F.explode(F.array(*[F.lit(a) for a in grid])))
                .groupBy("a").agg(F.sum(term).alias("z"), F.sum(term * F.col("a") * F.log("total")).alias("e"),
                                  F.max("total").alias("most"), F.min("total").alias("least")).collect())
        if not rows:
            return 1.0
        if entropy is None:
            meets = {r.a: (r.most / r.least) ** (1 - r.a) <= max_repeats for r in rows}
        else:
            meets = {r.a: math.log(r.z) - r.e / r.z < entropy for r in rows}  # the first exponent that falls short
        if meets[grid[0]]:
            return low
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if meets[middle] else (middle, high)
    return high if entropy is None else low


def plan(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, total, blocks, budget, passes, rest): what each source is to give.

    Without ``budget`` the total is the least at which no source is cut: the
    least repeated one is passed exactly once.  Otherwise it is that many tokens.
    ``passes`` are whole, ``rest`` are the tokens of one more, partial pass.
    """
    totals = source_totals(docs)
    a = bisect_exponent(totals, max_repeats, entropy)
    most = totals.agg(F.max("total").alias("m")).first()["m"] or 1
    raw = F.when(F.col("total") > 0, F.col("total") * F.pow(F.col("total") / F.lit(float(most)), F.lit(a - 1.0))).otherwise(0.0)
    scale = 1.0
    if budget is not None:
        scale = budget / (totals.agg(F.sum(raw).alias("s")).first()["s"] or 1.0)
    given = totals.withColumn("budget", F.floor(raw * scale).cast("bigint"))
    passes = F.when(F.col("total") > 0, F.floor(F.col("budget") / F.col("total"))).otherwise(F.lit(1)).cast("bigint")
    return settle(given.withColumn("passes", passes).withColumn("rest", F.col("budget") - F.when(F.col("total") > 0, F.col("passes") * F.col("total")).otherwise(0))
                  .withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("bigint")).drop("docs"))


def _draw(epoch: Column, key: Column) -> Column:
    return draw(SEED, "mix", epoch, key)


def _block(drawn: Column, blocks: Column) -> Column:
    """Blocks are even ranges of the 60-bit draw, so their order is that of the draws."""
    return F.shiftright(F.shiftright(drawn, 20) * blocks, 40)


def schedule(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, source, epoch, tokens, start_token): every use of a document and the tokens its source gave before.

    A pass that is not whole ends with the document that reaches the budget.
    Blocks, not sources, are the unit of the windows, so a source of any size is
    spread over many tasks; only block sums are added up per source.
    """
    uses = (docs.join(planned, "source").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes") + (F.col("rest") > 0).cast("bigint"))))
            .filter(F.col("epoch") <= F.col("passes") + (F.col("rest") > 0).cast("bigint"))
            .withColumn("drawn", _draw(F.col("epoch"), F.col("doc_id"))).withColumn("block", _block(F.col("drawn"), F.col("blocks"))))
    uses = settle(uses)
    unit = ["source", "epoch", "block"]
    sums = uses.groupBy(*unit).agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    inside = Window.partitionBy(*unit).orderBy("drawn", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (uses.withColumn("_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, unit)
              .withColumn("_at", F.col("offset") + F.col("_in")))
    return (placed.filter((F.col("epoch") <= F.col("passes")) | (F.col("_at") < F.col("rest")))
            .select("doc_id", "source", "epoch", "tokens", ((F.col("epoch") - 1) * F.col("total") + F.col("_at")).alias("start_token")))


def mix(df: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None,
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The schedule of a table of documents.

    * NULL source: counts as the source "".  NULL or empty text: no tokens, used
      with the whole passes of its source (once, if the source has no tokens).
    * NULL keys share one draw; ties are ordered by key and tokens.
    * Repeated rows are documents of their own.  No rows: no rows.
    """
    docs = settle(measured(df, key, text, source))
    return schedule(docs, plan(docs, max_repeats, entropy, budget))


def mixed(df: DataFrame, max_repeats: float = MAX_REPEATS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows themselves, each as often as the schedule uses it; all columns stay.

    Within a pass documents are ordered by their draw, so a partial pass is a cut
    in the draws: one number per source, found from the schedule's block sums,
    goes back to the documents instead of the schedule, and no text is shuffled
    where the sources fit a broadcast.
    """
    docs = settle(measured(df, key, text, source))
    planned = plan(docs, max_repeats)
    used = schedule(docs, planned).join(planned.select("source", "passes"), "source").filter(F.col("epoch") > F.col("passes"))
    cuts = used.groupBy("source").agg(F.max(_draw(F.col("epoch"), F.col("doc_id"))).alias("_cut"))
    given, passes, cut, origin, copy = (unused(name, df) for name in ("given", "passes", "cut", "origin", "copy"))
    table = settle(planned.select("source", "passes").join(cuts, "source", "left").select(
        F.col("source").alias(given), F.col("passes").alias(passes), F.coalesce("_cut", F.lit(-1)).alias(cut)))
    last = (_draw(F.col(passes) + 1, F.col(key)) <= F.col(cut)).cast("bigint")
    copies = F.array_repeat(F.lit(1), (F.col(passes) + last).cast("int"))
    joined = df.withColumn(origin, F.coalesce(F.col(source), F.lit(""))).join(table, F.col(origin) == F.col(given))
    return joined.withColumn(copy, F.explode(copies)).select(*[F.col(f"`{c}`") for c in df.columns])


SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(source,'') AS source, len(regexp_extract_all(coalesce(text,''), '{WORD}'))::BIGINT AS tokens FROM documents),
totals AS MATERIALIZED (SELECT source, count(*) AS docs, sum(tokens)::BIGINT AS total FROM d GROUP BY source),
ends AS (SELECT max(total)::DOUBLE AS most, min(total)::DOUBLE AS least FROM totals WHERE total > 0),
search(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT step+1, CASE WHEN pow(most/least, 1-(low+high)/2) <= {MAX_REPEATS} THEN low ELSE (low+high)/2 END,
        CASE WHEN pow(most/least, 1-(low+high)/2) <= {MAX_REPEATS} THEN (low+high)/2 ELSE high END FROM search, ends WHERE step < {STEPS * BATCHES}),
found AS (SELECT CASE WHEN most/least <= {MAX_REPEATS} THEN 0.0 ELSE high END AS a, most FROM search, ends WHERE step = {STEPS * BATCHES}),
given AS (SELECT source, docs, total, CASE WHEN total > 0 THEN floor(total*pow(total/most, a-1.0))::BIGINT ELSE 0 END AS budget FROM totals, found),
planned AS (SELECT source, total, budget, CASE WHEN total > 0 THEN budget//total ELSE 1 END AS passes,
    CASE WHEN total > 0 THEN budget % total ELSE 0 END AS rest FROM given),
uses AS (SELECT doc_id, source, tokens, total, passes, rest, unnest(range(1, passes + (rest > 0)::INT + 1)) AS epoch FROM d JOIN planned USING (source)),
drawn AS (SELECT *, {draw_sql(SEED, "mix", "epoch", "doc_id")} AS drawn FROM uses),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY drawn, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM drawn)
SELECT doc_id, source, epoch::BIGINT AS epoch, tokens, ((epoch-1)*total + ahead)::BIGINT AS start_token FROM placed WHERE epoch <= passes OR ahead < rest
"""
