"""Permutations, bootstraps and folds from keyed draws."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.draws import Texts, by_length, draw, draw_grid
from ..functions.stats import ratio, signed_rank_exact
from ..functions.stats import normal_two_sided
from ..session import settle, spread
from .ranking import grouped_quantiles, row_numbers, running_totals

PIECE = 1 << 16  # rows of a group, by index or by rank of the score, that one task counts together
TOGETHER = 40  # replicates that one task counts together
PERMUTATIONS_A_TASK = 28  # permutations of all samples that one task makes
DRAWS_TOGETHER = 1 << 23  # draws that it holds at once


def packed_pieces(rows: DataFrame, size: int) -> DataFrame:
    """(_piece, _rows): rows numbered ``_k`` = 1, 2, ... in pieces of ``size``, each the bytes of one compressed table in that order."""
    pieces = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("_piece", F.floor((F.col("_k") - 1) / size).cast("int")).repartition(pieces, "_piece").sortWithinPartitions("_k")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held).drop_columns(["_k", "_piece"]).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["_piece", "_rows"])

        at, held = None, []
        for batch in batches:
            piece = batch["_piece"].to_numpy()
            edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)]
            for i, j in zip(edges, edges[1:]):
                if i < j and held and piece[i] != at:
                    yield out()
                    held = []
                if i < j:
                    at = int(piece[i])
                    held.append(batch.slice(i, j - i))
        if held:
            yield out()

    return dealt.mapInArrow(pack, "_piece int, _rows binary")


def unpacked(pieces: Sequence[pa.Buffer], *names: str) -> list[pa.Array]:
    """Columns of packed pieces, one piece after another; the others are not expanded."""
    found = [pa.ipc.open_stream(pieces[0]).schema.get_field_index(n) for n in names]
    options = pa.ipc.IpcReadOptions(included_fields=found)
    table = pa.concat_tables(pa.ipc.open_stream(p, options=options).read_all() for p in pieces)
    return [table[n].combine_chunks() for n in names]


def by_permutations(pieces: DataFrame, permutations: int, run: Callable[[int, int, list[pa.Buffer]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``run(first, last, pieces)`` for every PERMUTATIONS_A_TASK permutations, one task each, with all packed pieces in order.

    The order of all samples under a permutation is found in one task from draws made there, so nothing is sent for a
    draw; the packed samples are copied once for each task.
    """
    units = -(-permutations // PERMUTATIONS_A_TASK)
    copies = pieces.withColumn("_unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1))))
    dealt = copies.repartitionById(units, F.col("_unit")).sortWithinPartitions("_unit", "_piece").select("_unit", "_rows")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((unit.as_py(), packed) for batch in batches for unit, packed in zip(batch["_unit"], batch["_rows"]))
        for unit, mine in groupby(rows, key=lambda row: row[0]):
            yield from run(unit * PERMUTATIONS_A_TASK + 1, min((unit + 1) * PERMUTATIONS_A_TASK, permutations), [packed.as_buffer() for _, packed in mine])

    return dealt.mapInArrow(task, schema)


def draws_in_turn(seed: int, purpose: str, first: int, last: int, keys: Texts, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(perm, draws of all ``n`` keys) for the permutations from ``first`` to ``last``; DRAWS_TOGETHER are held at once."""
    step = max(1, DRAWS_TOGETHER // max(n, 1))
    for start in range(first, last + 1, step):
        perms = range(start, min(start + step, last + 1))
        for perm, draws in zip(perms, list(draw_grid([f"{seed}|{purpose}|{p}|" for p in perms], keys))):
            yield perm, draws
            del draws  # so that the grid goes before the next is made


def order_of(draws: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Places in the order of the draws, equal ones by id."""
    order = np.argsort(draws)
    ordered = draws[order]
    if (ordered[1:] == ordered[:-1]).any():
        order = np.lexsort((pc.rank(ids, tiebreaker="first").to_numpy(), draws))
    return order


def permuted_column(samples: DataFrame, column: str, permutations: int, seed: int, along: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(perm, *along, value): a column shuffled over all samples, each with the columns ``along`` of the sample it comes to.

    A task makes the rows of its permutations; they move only if a later step needs it.
    """
    base = samples.select("sample_id", F.lit(0).alias("_g"), F.col(column).alias("_value"), *[F.col(c).alias(f"_along{i}") for i, c in enumerate(along)])
    ordered = row_numbers(base.withColumn("_d", draw(seed, "order", F.col("sample_id"))), ["_g"], "_d", "sample_id", "_k").drop("_d", "_g")
    pieces = settle(packed_pieces(settle(ordered.withColumn("_key", F.col("sample_id").cast("string"))), PIECE))
    names = ["perm", *along, "value"]

    def run(first: int, last: int, held: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        keys = by_length(*unpacked(held, "_key"))
        ids, value, *others = unpacked(held, "sample_id", "_value", *[f"_along{i}" for i in range(len(along))])
        place = np.empty(len(ids), np.int64)
        for perm, draws in draws_in_turn(seed, f"permute_{column}", first, last, keys, len(ids)):
            place[order_of(draws, ids)] = np.arange(len(ids))
            for i in range(0, len(ids), PIECE):
                got = value.take(pa.array(place[i:i + PIECE]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), perm, np.int32)), *[o.slice(i, len(got)) for o in others], got], names)

    schema = StructType([StructField("perm", IntegerType()), *[StructField(c, samples.schema[c].dataType) for c in along], StructField("value", samples.schema[column].dataType)])
    return by_permutations(pieces, permutations, run, schema)


def empirical_p(null: DataFrame, observed: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(1 + #null >= observed) / (#null + 1)."""
    return null.groupBy(*keys).agg(
        F.count(value).alias("replicates"),
        ((1 + F.count_if(F.col(value) >= observed)) / (F.count(value) + 1)).alias("empirical_p"))


def bootstrap_auroc(scored: DataFrame, keys: Sequence[str], score: str, label: str, replicates: int, seed: int,
                    row_key: str = "sample_id") -> DataFrame:
    """Percentile interval of the AUROC under resampling with replacement.

    Row j of a replicate takes the row whose index is a keyed draw modulo the
    group size; repeats become weights, one-class replicates are skipped.

    No row exists per draw, and no task holds a group.  Tasks draw for PIECE rows and TOGETHER replicates at a time and
    send two bytes a draw to the piece of indices it falls in; there draws become counts, which go on to the
    piece of scores they belong to; there they are added up in order of the score.
    """
    keys = list(keys)
    named = scored.select(*keys, row_key, score, label).filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys) or "true")
    indexed = settle(row_numbers(named.withColumn("_d", draw(seed, "order", F.col(row_key))), keys, "_d", row_key, "_i").drop("_d"))
    sizes = settle(indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.to_json(F.struct(*keys)))
                   .withColumn("_head", F.concat_ws("|", F.lit(str(seed)), F.lit("bootstrap"), *[F.col(k).cast("string") for k in keys])))
    below = running_totals(indexed.withColumn("_one", F.lit(1)), keys, score, ["_one"]).select(*keys, score, "_one_below")
    side = F.when(F.col(label) == 1, 1).when(F.col(label) == 0, 0)
    codes = (indexed.join(below, [*keys, score]).withColumn("_side", side).filter("_side IS NOT NULL")
             .join(sizes.select(*keys, "_key"), keys)
             .select("_key", F.floor((F.col("_i") - 1) / PIECE).cast("int").alias("_piece"),
                     F.pmod(F.col("_i") - 1, F.lit(PIECE)).cast("int").alias("_at"), (F.col("_one_below") * 2 + F.col("_side")).alias("_code")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // TOGETHER))).alias("_block")
    lookup = (codes.groupBy("_key", "_piece").agg(F.collect_list(F.struct("_at", "_code")).alias("_c"))
              .select("_key", "_piece", blocks, F.col("_c._at").alias("_ints"), F.col("_c._code").alias("_codes"), F.lit(None).cast("binary").alias("_bytes")))
    units = (sizes.select("_key", "_head", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(PIECE).cast("bigint"))).alias("_first"))
             .select("_key", "_head", "_n", "_first", blocks)
             .withColumn("_unit", F.concat_ws("|", "_key", "_first", "_block")))
    drawn = spread(units, "_unit").drop("_unit").mapInArrow(
        _draws_by_piece(replicates), "_key string, _piece int, _block int, _ints array<int>, _codes array<bigint>, _bytes binary")
    counted = drawn.unionByName(lookup).groupBy("_key", "_piece", "_block").applyInArrow(
        _counts_by_score, "_key string, _block int, _part bigint, _codes array<int>, _width int, _bytes binary")
    parts = settle(counted.groupBy("_key", "_block", "_part").applyInArrow(
        _wins_of_part, "_key string, replicate int, _part bigint, _pos bigint, _neg bigint, _wins double"))
    before = Window.partitionBy("_key", "replicate").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    summed = (parts.withColumn("_lower", F.coalesce(F.sum("_neg").over(before), F.lit(0)))
              .groupBy("_key", "replicate").agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
                                                F.sum(F.col("_wins") + F.col("_pos").cast("double") * F.col("_lower")).alias("_wins")))
    valid = settle(summed.filter("n_pos > 0 AND n_neg > 0").join(sizes.select(*keys, "_key"), "_key").select(
        *keys, "replicate", (F.col("_wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auroc")))
    interval = grouped_quantiles(valid, keys, "auroc", [0.025, 0.975])
    return (interval.join(valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates_used")), keys)
            .withColumnsRenamed({"q0": "ci_low", "q1": "ci_high"}))


def _draws_by_piece(replicates: int):
    """Units (key, head, n, first row, block of replicates) to the draws that fall in each piece of indices: their
    number per replicate and their places, two bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in (u for batch in batches for u in batch.to_pylist()):
            n, first, block = unit["_n"], unit["_first"], unit["_block"]
            heads = [f"{unit['_head']}|{r}|" for r in range(block * TOGETHER + 1, min((block + 1) * TOGETHER, replicates) + 1)]
            index = draw_grid(heads, [str(j) for j in range(first + 1, min(first + PIECE, n) + 1)])
            index %= np.uint64(n)
            if n > PIECE:
                index.sort(axis=1)
            edges = np.arange(0, n + PIECE, PIECE, dtype=np.uint64)
            cuts = [np.searchsorted(row, edges) if n > PIECE else (0, len(row)) for row in index]
            low = (index & np.uint64(PIECE - 1)).astype(np.uint16)
            for piece in range(-(-n // PIECE)):
                mine = [row[c[piece]:c[piece + 1]] for row, c in zip(low, cuts)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([unit["_key"]]), pa.array([piece], pa.int32()), pa.array([block], pa.int32()), pa.array([list(map(len, mine))], pa.list_(pa.int32())),
                    pa.array([None], pa.list_(pa.int64())), pa.array([b"".join(m.tobytes() for m in mine)], pa.binary())],
                    ["_key", "_piece", "_block", "_ints", "_codes", "_bytes"])
    return run


def _counts_by_score(table: pa.Table) -> pa.Table:
    """Draws of a piece of indices, counted and dealt to the pieces of scores: codes (rank of the score, class) and a
    count for each replicate and code."""
    counts, place, code = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lengths, codes, places in zip(table["_ints"], table["_codes"], table["_bytes"]):
        if codes.is_valid:
            place, code = lengths.values.to_numpy(), codes.values.to_numpy()
            continue
        ends = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])
        if counts is None:
            counts = np.zeros((len(ends) - 1, PIECE), np.uint32)
        flat = np.frombuffer(places.as_buffer(), np.uint16)
        for r, (i, j) in enumerate(zip(ends, ends[1:])):
            counts[r] += np.bincount(flat[i:j], minlength=PIECE).astype(np.uint32)
    out = []
    if counts is not None and len(code):
        order = np.argsort(code, kind="stable")
        code, ordered = code[order], counts[:, place[order]]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, ordered = code[first], np.add.reduceat(ordered, first, axis=1)
        part = code // (2 * PIECE)
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for i, j in zip(edges, edges[1:]):
            mine = ordered[:, i:j]
            mine = mine.astype(np.min_scalar_type(int(mine.max())))
            out.append((int(part[i]), (code[i:j] - part[i] * 2 * PIECE).astype(np.int32), mine.dtype.itemsize,
                        pa.compress(mine.tobytes(), codec="zstd", asbytes=True)))
    key, block = (table[c][0].as_py() for c in ("_key", "_block"))
    parts, codes, widths, packed = zip(*out) if out else ((),) * 4
    return pa.table({"_key": pa.array([key] * len(out), pa.string()), "_block": pa.array([block] * len(out), pa.int32()), "_part": pa.array(parts, pa.int64()),
                     "_codes": pa.array(codes, pa.list_(pa.int32())), "_width": pa.array(widths, pa.int32()), "_bytes": pa.array(packed, pa.binary())})


def _wins_of_part(table: pa.Table) -> pa.Table:
    """Per replicate, the drawn cases and controls of a piece of scores, and the pairs in it that a case wins."""
    pos = neg = None
    for codes, width, packed in zip(table["_codes"], table["_width"], table["_bytes"]):
        code, kind = codes.values.to_numpy(), np.dtype(f"u{width.as_py()}")
        most = TOGETHER * len(code) * kind.itemsize
        counts = np.frombuffer(_unpacked(packed.as_py(), most), kind).reshape(-1, len(code))
        if pos is None:
            pos, neg = (np.zeros((len(counts), PIECE), np.int32) for _ in range(2))
        case = code % 2 == 1
        pos[:, code[case] >> 1] += counts[:, case].astype(np.int32)
        neg[:, code[~case] >> 1] += counts[:, ~case].astype(np.int32)
    n, rows = len(pos), []
    for p, q in zip(pos, neg):
        p, q = p.astype(np.float64), q.astype(np.float64)
        rows.append((int(p.sum()), int(q.sum()), float(p @ (np.cumsum(q) - q / 2))))
    key, block, part = (table[c][0].as_py() for c in ("_key", "_block", "_part"))
    n_pos, n_neg, wins = zip(*rows)
    return pa.table({"_key": pa.array([key] * n), "replicate": pa.array(range(block * TOGETHER + 1, block * TOGETHER + n + 1), pa.int32()),
                     "_part": pa.array([part] * n, pa.int64()), "_pos": pa.array(n_pos, pa.int64()), "_neg": pa.array(n_neg, pa.int64()), "_wins": pa.array(wins, pa.float64())})


def _unpacked(packed: bytes, most: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed, max_output_size=most)


def bootstrap_median(values: DataFrame, keys: Sequence[str], value: str, row_key: str, replicates: int,
                     seed: int) -> DataFrame:
    """Percentile interval of the median of a few paired differences per key."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(row_key)
    present = values.filter(F.col(value).isNotNull())
    indexed = settle(present.select(*keys, row_key, value, F.row_number().over(order).alias("_i"),
                                    F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n")))
    drawn = (indexed.select(*keys, "_n", "_i", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
             .withColumn("_i", 1 + F.pmod(draw(seed, "bootstrap", *[F.col(k) for k in keys], F.col("replicate"),
                                               F.col("_i")), F.col("_n"))))
    medians = (drawn.join(indexed.select(*keys, "_i", value), [*keys, "_i"])
               .groupBy(*keys, "replicate").agg(F.median(value).alias("_m")))
    return medians.groupBy(*keys).agg(
        F.percentile("_m", F.lit(0.025)).alias("bootstrap_ci_low"),
        F.percentile("_m", F.lit(0.975)).alias("bootstrap_ci_high"))


def stratified_folds(samples: DataFrame, seed: int, keys: Sequence[str] = ("cohort",)) -> DataFrame:
    """Fold 0..k-1 per sample, k = max(3, min(5, smallest class)), classes spread evenly."""
    keys = list(keys)
    sizes = samples.groupBy(*keys, "condition").agg(F.count(F.lit(1)).alias("_n"))
    folds = sizes.groupBy(*keys).agg(
        F.greatest(F.lit(3), F.least(F.lit(5), F.min("_n"))).cast("int").alias("n_folds"))
    drawn = samples.select("sample_id", *keys, "condition").withColumn("_d", draw(seed, "fold", F.col("sample_id")))
    ranked = row_numbers(drawn, [*keys, "condition"], "_d", "sample_id", "_k").drop("_d")
    return ranked.join(folds, keys).select(
        "sample_id", *keys, "condition", "n_folds", F.pmod(F.col("_k") - 1, F.col("n_folds")).cast("int").alias("fold"))


def signed_rank(differences: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two-sided signed-rank test per key over folds; zeros are dropped.

    Exact for up to fifty untied differences without zeros, else the normal
    approximation with tie correction; NULL if every difference is zero.
    """
    keys = list(keys)
    rows = differences.filter(F.col(value).isNotNull())
    zeros = rows.groupBy(*keys).agg(F.count_if(F.col(value) == 0).alias("_zeros"))
    used = rows.filter(F.col(value) != 0).withColumn("_a", F.abs(value))
    by_size = Window.partitionBy(*keys).orderBy("_a")
    same = Window.partitionBy(*keys, "_a")
    ranked = (used.withColumn("_k", F.count(F.lit(1)).over(same).cast("double"))
              .withColumn("_r", F.rank().over(by_size) + (F.col("_k") - 1) / 2))
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_used"), F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("rank_sum"),
        F.sum(F.col("_k") * F.col("_k") - 1).alias("_ties"))
    n = F.col("n_used").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    exact = (F.col("n_used") <= 50) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    return (zeros.join(sums, keys, "left")
            .withColumn("_z", ratio(F.col("rank_sum") - n * (n + 1) / 4, spread))
            .withColumn("pvalue", F.when(exact, signed_rank_exact("rank_sum", "n_used")).otherwise(normal_two_sided("_z")))
            .select(*keys, F.coalesce("n_used", F.lit(0)).alias("n_used"), "rank_sum", "pvalue"))
