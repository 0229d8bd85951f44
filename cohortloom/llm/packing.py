"""Best-fit decreasing packing of token pieces into sequences of fixed capacity.

Best-fit decreasing takes pieces from the longest to the shortest and puts each
into the open bin with the least room that still takes it.  Pieces of one length,
and bins with one room, cannot be told apart, so the plan is made from the count of
pieces per length: a segment tree over the possible rooms finds the tightest
room that is in use and large enough in logarithmic time, and the bins of that
room are filled one after the other.  This is best-fit decreasing over the whole
corpus, yet the driver sees one count per length (CAPACITY at most), never pieces.

A plan row says which ranks among the pieces of a length go to which run of
sequences, and at which offset.  Ranks come from the tasks that cut the pieces:
each numbers its own by length, and running totals over the tasks shift them.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .segments import Words, sliced

CAPACITY = 4096
END = 1  # the id after each document
SLICE_BYTES = 8 << 20
RANK_BITS = 48


class Rooms:
    """Segment tree over rooms 0..capacity; a leaf is set while bins with that room are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.size)

    def set(self, room: int, used: bool) -> None:
        at = room + self.size
        self.used[at] = used
        while at > 1:
            at >>= 1
            self.used[at] = self.used[2 * at] | self.used[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The smallest used room of at least ``need``, -1 if there is none."""
        at = need + self.size
        if not self.used[at]:
            while at > 1 and (at & 1 or not self.used[at + 1]):  # up to the first right neighbour in use
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.size:
                at = 2 * at if self.used[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, offset, per sequence) rows, in order of length and rank.

    A row holds for the ranks up to the next row of its length.  A bin that takes
    one piece is the tightest for the next of that length while it has room, so each gets
    ``per sequence`` pieces before the next bin.  Open bins are kept as runs of consecutive sequences
    with one room; a length adds two runs at most, so the plan's size is bounded by
    the capacity and does not grow with the number of pieces.
    """
    rooms, runs, rows, opened = Rooms(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, size: int) -> None:
        if room and size:
            runs[room].append((first, size))
            rooms.set(room, True)

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = rooms.tightest(length)
            if room < 0:
                room, first, size = capacity, opened, -(-left // (capacity // length))
                opened += size
            else:
                first, size = runs[room].pop()
                rooms.set(room, bool(runs[room]))
            each = room // length
            full = min(size, left // each)
            part = left - full * each if full < size else 0
            rows.append((length, rank, first, capacity - room, each))
            put(room - each * length, first, full)
            put(room - part * length, first + full, int(part > 0))
            put(room, first + full + (part > 0), size - full - (part > 0))
            rank, left = rank + full * each + part, left - full * each - part
    return sorted(rows)


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], slot, rank) of every row, written once.

    ``tokenizer`` is the path of a tokenizer JSON file on the driver.  A document is
    its ids without special tokens around it, then END; a NULL or empty text is END
    alone.  Only what is longer than the capacity is cut, into pieces of it and a last one.  Rows without
    a key and repeated rows are packed like any other.  ``rank`` counts the pieces of one length in one task, the ``slot``.
    """
    file = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kinds = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"} | ({"ids": "binary"} if ids else {})
    kinds |= {"slot": "int", "rank": "bigint"}
    types = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        coder, slot, seen = Tokenizer.from_str(file.value.decode()), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = array("I", [END]).tobytes()
        words = Words(coder)
        for batch in (part for whole in batches for part in sliced(whole, 1, SLICE_BYTES)):
            rows, (ids_all, at_all) = [], words.of(batch.column(1))
            for name, first, last in zip(batch.column(0).to_pylist(), at_all, at_all[1:]):
                coded = ids_all[first:last].tobytes() + end
                for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                    own = coded[at:at + 4 * capacity]
                    rows.append((name, piece, at // 4, len(own) // 4, zlib.crc32(own), *((own,) if ids else ()), slot, seen[len(own) // 4]))
                    seen[len(own) // 4] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(kinds))

    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return settle(rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items())))


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset instead of slot and rank."""
    held = settle(cut.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n")))
    rows = plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(rows, np.int64).reshape(-1, 5)
    shipped = cut.sparkSession.sparkContext.broadcast((table[:, 0] << RANK_BITS | table[:, 1], table[:, 1:]))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    kept = [c for c in cut.columns if c not in ("slot", "rank")]
    at = kept.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shipped.value
        for batch in batches:
            length, rank = batch.column(at).to_numpy(), batch.column(len(kept)).to_numpy()
            first, sequence, offset, each = rows[np.searchsorted(keys, length << RANK_BITS | rank, side="right") - 1].T
            on, inside = np.divmod(rank - first, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + on), pa.array(offset + inside * length)],
                                             [*kept, "sequence_id", "offset"])

    ranked = cut.join(shifts, ["length", "slot"]).select(*kept, (F.col("_before") + F.col("rank")).alias("_rank"))
    return ranked.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in cut.select(*kept).dtypes) + ", sequence_id bigint, offset bigint")


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all documents; no rows: none."""
    return place(pieces(df, tokenizer, capacity, **columns), capacity)
