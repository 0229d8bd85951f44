"""Order MinHash: fingerprints that follow edit distance.

Every k-mer of a text is numbered by its occurrence, so repeats count.  For each
of SKETCHES hash functions the TUPLE smallest numbered k-mers are taken, put back
into text order and hashed together; the share of equal tuple hashes estimates
how much text two documents have in common in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import settle
from .rows import SLICE, map_rows, sha

K = 12
TUPLE = 2
SKETCHES = 32
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(2024).integers(1, 2 ** 31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_AREA = 2_000_000  # hash values looked at together


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def kmers(text: str) -> np.ndarray:
    """64-bit hashes of the k-mers of code points; a shorter text is one k-mer."""
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(h) == 0:
        return h
    if len(h) < K:
        return _stir(np.array([sum(int(c) * pow(int(_BASE), i, 2 ** 64) for i, c in enumerate(h)) % 2 ** 64 ^ len(h)], np.uint64))
    power, width, grown = _BASE, 1, h
    parts = {1: h}
    while width < K:
        grown = grown[:-width] * power + grown[width:] if len(grown) > width else grown[:0]
        width, power = width * 2, np.uint64(int(power) ** 2 % 2 ** 64)
        parts[width] = grown
    total, done = None, 0
    for w in (8, 4):
        piece = parts[w][done:]
        total = piece if total is None else total[:len(piece)] * np.uint64(pow(int(_BASE), w, 2 ** 64)) + piece
        done += w
    return _stir(total[:len(h) - K + 1])


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    n = len(h)
    bits = np.uint64(max(1, int(n).bit_length()))
    ordered = np.sort((h << bits) | np.arange(n, dtype=np.uint64))  # the value's low bits, then its place
    place = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.ones(n, bool)
    first[1:] = (ordered[1:] >> bits) != (ordered[:-1] >> bits)
    count = np.arange(n)
    out = np.empty(n, np.int64)
    out[place] = count - np.maximum.accumulate(np.where(first, count, 0))
    return out


def signature(text: str) -> np.ndarray:
    """SKETCHES tuple hashes; zeros for an empty text."""
    h = kmers(text)
    n = len(h)
    if n == 0:
        return np.zeros(SKETCHES, np.uint32)
    numbered = (_stir(h + occurrences(h).astype(np.uint64) * _MIX) >> np.uint64(32)).astype(np.uint32)
    take = min(TUPLE, n)
    chosen = np.empty((SKETCHES, take), np.int64)
    step = max(1, _AREA // n)
    for s in range(0, SKETCHES, step):
        values = numbered[None, :] * _FACTORS[s:s + step, None]
        lines = np.arange(len(values))
        for j in range(take):
            at = values.argmin(axis=1)
            chosen[s:s + step, j] = at
            values[lines, at] = np.uint32(0xFFFFFFFF)
    chosen.sort(axis=1)
    out = np.full(SKETCHES, np.uint64(take), np.uint64)
    for j in range(take):
        out = _stir(out * _BASE + h[chosen[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row, in hexadecimal.

    A NULL text counts as empty; empty texts share one fingerprint; equal texts
    have equal fingerprints.  Rows without a key and repeated rows are returned;
    other columns are not read.  Work is by row: no shuffle.
    """
    return map_rows(df, {"doc_id": F.col(key), "text": F.col(text)}, "doc_id bigint, fingerprint string",
                    lambda: lambda columns: [(name, as_text(signature(t or ""))) for name, t in zip(*columns)])


# ---------------------------------------------------------------- each document against an edit of itself and the next

RESULT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_SHARED = RESULT + ", part int, last boolean, text string, head string"


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(key, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
    changed = edited(text, following)
    sketch = signature(changed)
    return (key, len(text), sha(changed.encode()), as_text(own), as_text(sketch), likeness(own, sketch), likeness(own, other))


def against_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT for every row, against the next row in descending key order (after the last: the first).

    * NULL text: empty.  NULL keys come last.  Equal keys follow the text's hash,
      so repeated rows follow each other.  A single row is its own next.
    * Rows are dealt by key range; within a range each row meets the next.  Only
      the first and last row of each range are matched up afterwards, so the
      texts move once and no task sees more than its range.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    dealt = (df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .repartitionByRange(parts, *order).sortWithinPartitions(*order))
    arrow = to_arrow_schema(T.StructType.fromDDL(_SHARED))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, held = TaskContext.get().partitionId(), None
        for piece in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = []
            for name, value in zip(*(c.to_pylist() for c in piece.columns)):
                sketch = signature(value)
                if held is None:
                    rows.append((None,) * 7 + (part, False, None, value))
                else:
                    rows.append(_compare(*held, value, sketch) + (part, None, None, None))
                held = name, value, sketch
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if held is not None:
            row = (held[0],) + (None,) * 6 + (part, True, held[1], None)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, arrow)], schema=arrow)

    shared = settle(dealt.mapInArrow(pair, _SHARED))
    # one row per range from here on: its last document and its first
    ends = shared.filter(F.col("last").isNotNull()).groupBy("part").agg(
        F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.max("head").alias("head"))
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("doc_id", "text", F.coalesce(F.lead("head").over(along), F.first("head").over(whole)).alias("following"))
    fixed = map_rows(ends, {c: F.col(c) for c in ("doc_id", "text", "following")}, RESULT, lambda: lambda columns: [
        _compare(name, t, signature(t), following, signature(following)) for name, t, following in zip(*columns)])
    return shared.filter(F.col("last").isNull()).select(*fixed.columns).unionByName(fixed)
