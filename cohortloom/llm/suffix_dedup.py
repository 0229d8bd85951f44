"""Removal of repeated byte strings with a suffix array.

A string of LENGTH bytes that starts in two places has, in both, the same anchor:
the leftmost minimal hash of the SEED-byte strings in it.  So places that share
no anchor are out at once, and equal stretches around an anchor are settled by
their hash.  Only stretches that share an anchor and differ somewhere need
sorting.  On a grid of STEP bytes from the anchor, STEP neighbouring strings
share a core; a unit is that core, as one symbol, between the few bytes beside
it, and two strings are equal where 16 symbols are.  The units are sorted by
``suffix_array``: linear grouping by Lyndon prefixes, then each group's order
from the groups before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import settle
from .rows import SLICE, map_rows

LENGTH, SEED, STEP = 400, 48, 16
CORE = LENGTH - STEP + 1
UNITS_A_CALL = 40_000
#: Units of one core that are sorted in one call; larger classes are matched string by string in a grouping.
CLASS_LIMIT = 20_000
#: A key with more than a HEAVY-th of the rows to be joined is joined to them by broadcast: fewer than HEAVY such keys exist.
HEAVY = 1000
_BLOCK, _PLACE = 1 << 20, np.uint64(24)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_STIR = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- suffix array


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes; the last symbol must be smaller than all others.

    Groups start as the suffixes of equal first symbol and are treated in
    descending order.  Each member points to the nearest place before it that is in
    a lower group; the places pointed to grow by the group's prefix once for each
    pointer, so they move up within their groups by their number of pointers.  When all
    groups are done they are ordered by Lyndon prefix, and one ascending pass over
    the finished part of the array fills each group from its front.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, where = [0] * n, [0] * n  # a group is named by its first slot
    start = 0
    for slot, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = slot
        group[i], where[i] = start, slot
    previous, end = [-1] * n, n
    size: dict[int, int] = {}
    for i in order:
        size[group[i]] = size.get(group[i], 0) + 1
    while end:
        first = group[order[end - 1]]
        members = sorted(order[first:end])
        end = first
        pointers: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if not pointers:
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, count in pointers.items():
            by_count.setdefault(count, {}).setdefault(group[j], []).append(j)
        for count in sorted(by_count, reverse=True):
            for old, moved in by_count[count].items():
                left = size[old]
                if len(moved) == left:
                    continue  # the whole group moves: its place stays
                slot = old + left
                for j in moved:
                    slot -= 1
                    k = order[slot]
                    order[slot], order[where[j]] = j, k
                    where[k], where[j] = where[j], slot
                for j in moved:
                    group[j] = slot
                size[old], size[slot] = left - len(moved), len(moved)
    result, free, placed = [-1] * n, {}, [False] * n
    result[0], placed[n - 1] = n - 1, True
    for slot in range(n):
        j = result[slot] - 1
        while j >= 0 and not placed[j]:
            at = free.get(group[j], group[j])
            result[at], free[group[j]], placed[j] = j, at + 1, True
            j = previous[j]
    return result


# ---------------------------------------------------------------- stretches


class Hashes:
    """Prefix sums of a text for the hashes of its substrings, under two bases."""

    def __init__(self) -> None:
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self.grow(1 << 15)

    def grow(self, n: int) -> None:
        self.powers = [(np.cumprod(np.full(n, b, np.uint64)), np.cumprod(np.full(n, pow(b, -1, 2 ** 64), np.uint64))) for b in _BASES]

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if n >= len(self.powers[0][0]):
            self.grow(2 * n)
        self.sums = []
        wide = data.astype(np.uint64) + np.uint64(1)
        for power, _ in self.powers:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(wide * power[:n], out=total[1:])
            self.sums.append(total)

    def of(self, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[base][stop] - self.sums[base][start]) * self.powers[base][1][start] + (stop - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * _STIR
        return x ^ (x >> np.uint64(29))


def stretches(data: np.ndarray, hashes: Hashes) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, anchor place, first, last): runs of string starts with one anchor; for each block of a long text.

    ``hashes`` is left loaded with the text.
    """
    n = len(data)
    if n < LENGTH:
        return
    hashes.load(data)
    reach = LENGTH - SEED + 1
    for begin in range(0, n - LENGTH + 1, _BLOCK):
        stop = min(n - SEED + 1, begin + _BLOCK + reach - 1)
        at = np.arange(begin, stop)
        low = (hashes.of(0, at, at + SEED) >> _PLACE << _PLACE) | np.arange(len(at), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if reach > width:
            low = np.minimum(low[:width - reach], low[reach - width:])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.append(first[1:], len(low)) - 1
        place = (low[first] & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        yield (low[first] >> _PLACE).astype(np.int64), begin + place, begin + first, begin + last


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


_STRETCH = "doc_id bigint, mark bigint, anchor bigint, one bigint, two bigint, first bigint, last bigint"


def _stretch_rows(docs: DataFrame) -> DataFrame:
    schema = _arrow(_STRETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for key, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                for anchor, _, first, last in stretches(_bytes(text), hashes):
                    one, two = (hashes.of(b, first, last + LENGTH).view(np.int64) for b in (0, 1))
                    n = len(first)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                        ([key] * n, [mark] * n, anchor, one, two, first, last), schema)], schema=schema)

    return docs.select("doc_id", "mark", "text").mapInArrow(_gathered(run, schema), _STRETCH)


def _gathered(run, schema: pa.Schema, rows: int = 50_000):
    """The batches of ``run`` put together to at least ``rows`` rows."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held, schema).combine_chunks().to_batches()
    return gather


_UNIT = "doc_id bigint, mark bigint, at bigint, least int, most int, one bigint, two bigint, before binary, after binary"


def _unit_rows(texts: DataFrame) -> DataFrame:
    """Units of the wanted stretches (column ``wanted``: their firsts) of each text.

    ``at`` is where the core starts; the unit stands for the strings that start
    ``least`` to ``most`` bytes before it.
    """
    schema = _arrow(_UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                for key, mark, text, wanted in zip(*(c.to_pylist() for c in batch.slice(i, SLICE).columns)):
                    data, asked = _bytes(text), np.unique(np.array(wanted, np.int64))
                    raw = data.tobytes()
                    for _, place, first, last in stretches(data, hashes):
                        chosen = np.isin(first, asked)
                        at, least, most = [], [], []
                        for p, a, b in zip(place[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist()):
                            core = a + (p - a) % STEP
                            while core - STEP + 1 <= b:
                                at.append(core)
                                least.append(max(0, core - b))
                                most.append(min(STEP - 1, core - a))
                                core += STEP
                        if not at:
                            continue
                        cores = np.array(at, np.int64)
                        one, two = (hashes.of(h, cores, cores + CORE).view(np.int64) for h in (0, 1))
                        rows = ([key] * len(at), [mark] * len(at), at, least, most, one, two,
                                [raw[c - m:c] for c, m in zip(at, most)], [raw[c + CORE:c + LENGTH - m] for c, m in zip(at, least)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return texts.select("doc_id", "mark", "text", "wanted").mapInArrow(_gathered(run, schema), _UNIT)


_FOUND = "doc_id bigint, mark bigint, first bigint, last bigint"


def repeated_in_units(table: pa.Table) -> pa.Table:
    """Starts of strings that two units of the table have, by their suffix array.

    Equal units repeat all their strings and are sorted once.
    """
    one, two = (table[c].to_numpy() for c in ("one", "two"))
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    core = np.empty(len(order), np.int64)
    core[order] = np.cumsum(new) - 1
    befores, afters = (table[c].to_pylist() for c in ("before", "after"))
    at, most, least = (table[c].to_numpy() for c in ("at", "most", "least"))
    kinds: dict[tuple[int, bytes, bytes], list[int]] = {}
    for u, kind in enumerate(zip(core.tolist(), befores, afters)):
        kinds.setdefault(kind, []).append(u)
    variants = np.bincount([c for c, _, _ in kinds])
    units, first, last = [], [], []
    text: list[int] = []
    starts, unit_of, back_of = [], [], []
    for (c, before, after), same in kinds.items():
        u = same[0]
        if len(same) > 1:
            units += same
            first += [at[x] - most[x] for x in same]
            last += [at[x] - least[x] for x in same]
        if variants[c] > 1:
            for back in range(most[u], least[u] - 1, -1):
                starts.append(len(text) + most[u] - back)
                unit_of.append(u)
                back_of.append(back)
            text += [x + 2 for x in before]
            text.append(c + 258)
            text += [x + 2 for x in after]
            text.append(1)
    if text:
        text.append(0)
        sa = np.array(suffix_array(text))
        symbols = np.concatenate([np.array(text), np.zeros(STEP, np.int64)])
        equal = np.ones(len(sa) - 1, bool)
        for t in range(STEP):
            equal &= symbols[sa[:-1] + t] == symbols[sa[1:] + t]
        repeated = np.zeros(len(text), bool)
        repeated[sa[:-1][equal]] = True
        repeated[sa[1:][equal]] = True
        for i in np.flatnonzero(repeated[np.array(starts)]).tolist():
            begin = at[unit_of[i]] - back_of[i]
            if units and units[-1] == unit_of[i] and last[-1] == begin - 1:
                last[-1] = begin
            else:
                units.append(unit_of[i])
                first.append(begin)
                last.append(begin)
    picked = pa.array(units, pa.int64())
    return pa.table({"doc_id": table["doc_id"].take(picked), "mark": table["mark"].take(picked),
                     "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())})


def _among(rows: DataFrame, groups: DataFrame, same: list[str]) -> DataFrame:
    """Rows with the group of their key; ``groups`` (a settled table, read four times) has distinct keys and ``n``, their numbers of rows.

    The few keys with very many rows are broadcast, so their rows stay where they are; the rest is joined by hash.
    """
    heavy = F.col("n") * HEAVY > F.lit(groups.agg(F.sum("n")).first()[0] or 0)
    wide = F.broadcast(groups.filter(heavy))
    return rows.join(wide, same).unionByName(rows.join(wide.select(*same), same, "left_anti").join(groups.filter(~heavy), same))


def _repeated_in_large_classes(units: DataFrame) -> DataFrame:
    """The same for cores with very many units: every string is a row, grouped by core and the bytes beside it."""
    strings = units.withColumn("back", F.explode(F.sequence("least", "most")))
    strings = strings.select("doc_id", "mark", (F.col("at") - F.col("back")).alias("first"), "one", "two", "back",
                             F.substring("before", F.col("most") - F.col("back") + 1, F.col("back")).alias("x"),
                             F.substring("after", F.lit(1), F.lit(STEP - 1) - F.col("back")).alias("y"))
    same = ["one", "two", "back", "x", "y"]
    many = settle(strings.groupBy(*same).agg(F.count("*").alias("n")).filter("n > 1"))
    return _among(strings, many, same).select("doc_id", "mark", "first", F.col("first").alias("last"))


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last): ranges of starts of repeated strings; ``docs`` has (doc_id, mark, text)."""
    every = settle(_stretch_rows(docs))
    anchors = settle(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = settle(_among(every, anchors, ["anchor"]).drop("n"))
    same = ["anchor", "one", "two"]
    kinds = settle(shared.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "first")).alias("r")))
    whole = _among(shared, kinds.filter("n > 1").select(*same, "n"), same).select("doc_id", "mark", "first", "last")
    several = settle(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"))
    wanted = (_among(kinds.drop("n"), several, ["anchor"]).select("r.*").groupBy(F.col("doc_id").alias("_key"), F.col("mark").alias("_mark"))
              .agg(F.collect_set("first").alias("wanted")))  # at most the stretches of one text
    texts = docs.dropDuplicates(["doc_id", "mark"]).join(wanted, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("mark") == F.col("_mark")))
    units = settle(_unit_rows(texts))
    classes = settle(units.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1"))
    met = settle(_among(units, classes, ["one", "two"]))
    calls = max(1, met.count() // UNITS_A_CALL)
    met = met.withColumn("call", F.pmod(F.xxhash64("one", "two"), F.lit(calls)))
    sorted_ = met.filter(F.col("n") <= CLASS_LIMIT).drop("n").groupBy("call").applyInArrow(repeated_in_units, _FOUND)
    return whole.unionByName(sorted_).unionByName(_repeated_in_large_classes(met.filter(F.col("n") > CLASS_LIMIT).drop("n")))


def removed_spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed runs (start, stop) from ranges of string starts."""
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + LENGTH)
        else:
            out.append([first, last + LENGTH])
    return [(a, b) for a, b in out]


RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"


def remove(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT for every row: the removed runs of bytes and what is left.

    * NULL text: empty.  Texts shorter than LENGTH bytes lose nothing.
    * Rows are documents of their own: a repeated row repeats every string in it.
    * NULL keys and equal keys are told apart by the text.  No rows: no rows.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(value).alias("mark"), value.alias("text"))
    ranges = (repeated_starts(docs).groupBy(F.col("doc_id").alias("_key"), F.col("mark").alias("_mark"))
              .agg(F.collect_set(F.struct("first", "last")).alias("ranges")))
    joined = docs.join(settle(ranges), F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("mark") == F.col("_mark")), "left")

    def start():
        def work(columns: list[list]) -> list[tuple]:
            out = []
            for name, value_, found in zip(*columns):
                raw = value_.encode()
                spans = removed_spans([(r["first"], r["last"]) for r in found or []])
                edges = [0, *(x for s in spans for x in s), len(raw)]
                out.append((name, len(raw), spans, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            return out

        return work

    return map_rows(joined, {c: F.col(c) for c in ("doc_id", "text", "ranges")}, RESULT, start)
