"""Alignment of two tokenizers over the bytes of each text.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a
``sentencepiece`` model.  Both encode a space and the text.  One merge of the two
end-offset lists gives every overlapping token pair (a link) and every offset
where both end (a cut).  The merge runs for all documents of a slice at once: one
NumPy vector of A pointers and one of B pointers advance in lockstep, each step
writes one link, and a cut where both move, for each live document; finished documents are
compacted away when the first of them can have ended.  What is stored is one
byte per step, from which links, pairs and groups follow by running sums.

Counts of id pairs are of the whole corpus.  The most frequent ones, TOP at
most, travel to all tasks; links of the others are joined with the count table by pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .segments import Segments, sliced

#: Id pairs whose counts are broadcast (17 bytes each); all others are joined.
TOP = 1 << 20
#: Bytes of text worked on together, and links counted together.
SLICE_BYTES, COUNTED = 2 << 20, 2 << 20
#: Segments encoded as one text, and those that may be.
JOINED, PLAIN = 512, re.compile("[!-~¡-ɏ]+").fullmatch
SHIFT = 32  # a pair is a << SHIFT | b


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """Bytes of a sentencepiece entry."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def id_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


class Pair:
    """Both tokenizers in a task: ids by segment and the bytes of every id."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        characters = byte_of_character()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(characters[c] for c in entry) if all(c in characters for c in entry) else entry.encode()
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_type, self.b_type = id_type(len(self.a_bytes)), id_type(len(self.b_bytes))
        self.a_length, self.b_length = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        self.a_names, self.b_names = (np.array([f"{i}{end}" for end in ends for i in range(len(table))], object)
                                      for ends, table in ((",|", self.a_bytes), (",;", self.b_bytes)))
        self.a_opens, self.b_opens = (np.array([x.startswith(b" ") for x in table]) for table in (self.a_bytes, self.b_bytes))
        self.segments = Segments(self._encode)

    def _encode(self, segments: list[str]) -> list[tuple]:
        plain = [s for s in segments if PLAIN(s)]
        done = dict(pair for i in range(0, len(plain), JOINED) for pair in self._joined(plain[i:i + JOINED]))
        rest = [s for s in segments if s not in done]
        done.update(zip(rest, self._each(rest)))
        return [done[s] for s in segments]

    def _joined(self, segments: list[str]) -> Iterator[tuple]:
        """Values of segments encoded as one text, told apart by the tokens that begin with its spaces; halved where a
        tokenizer does not give the text back or joins over a space, and what then stands alone is left out."""
        text = " ".join(segments)
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.a_type)
        b = np.array(self.b.encode(text), self.b_type)
        at_a, at_b = np.flatnonzero(self.a_opens[a]), np.flatnonzero(self.b_opens[b])
        if len(at_a) == len(at_b) == len(segments) and self._same(" " + text, a.tolist(), b.tolist()):
            cut_a, cut_b = np.append(at_a, len(a)) * a.itemsize, np.append(at_b, len(b)) * b.itemsize
            a, b, cut_a, cut_b = a.tobytes(), b.tobytes(), cut_a.tolist(), cut_b.tolist()
            for s, i, j, k, n in zip(segments, cut_a, cut_a[1:], cut_b, cut_b[1:]):
                yield s, (a[i:j], b[k:n], True)
        elif len(segments) > 1:
            half = len(segments) // 2
            yield from self._joined(segments[:half])
            yield from self._joined(segments[half:])

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == text.encode() == b"".join(map(self.b_bytes.__getitem__, b))

    def _each(self, segments: list[str]) -> list[tuple]:
        spaced, a_code, b_code = [" " + s for s in segments], np.dtype(self.a_type).char, np.dtype(self.b_type).char
        coded = zip(spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(segments, num_threads=1))
        return [(array(a_code, a.ids).tobytes(), array(b_code, b).tobytes(), self._same(text, a.ids, b)) for text, a, b in coded]

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids of each text, none where the joined bytes of either differ from space + text."""
        a_all, b_all = [], []
        for text, parts in zip(texts, self.segments.of(texts)):
            a = np.frombuffer(b"".join([p[0] for p in parts]), self.a_type)
            b = np.frombuffer(b"".join([p[1] for p in parts]), self.b_type)
            if not text or not all([p[2] for p in parts]) and not (
                    b"".join([self.a_bytes[i] for i in a]) == (" " + text).encode() == b"".join([self.b_bytes[i] for i in b])):
                a, b = a[:0], b[:0]
            a_all.append(a)
            b_all.append(b)
        return a_all, b_all


def starts(lengths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray) -> np.ndarray:
    """One byte a step for every document, in order: 1 A moves, 2 B moves, 3 both (a cut).

    The ends of document d are a_ends[a_from[d]:a_from[d + 1]] and the same for b; both lists rise to the same last value.
    """
    live = np.flatnonzero(a_from[1:] > a_from[:-1])
    at_a, at_b, last_a, last_b = a_from[live], b_from[live], a_from[live + 1], b_from[live + 1]
    out, steps = at_a + at_b, np.zeros(len(a_ends) + len(b_ends), np.uint8)
    while len(at_a):
        for _ in range(int(np.maximum(last_a - at_a, last_b - at_b).min())):  # no document ends earlier
            a_end, b_end = a_ends[at_a], b_ends[at_b]
            move_a, move_b = a_end <= b_end, b_end <= a_end
            steps[out] = move_a + (move_b.view(np.uint8) << 1)
            at_a += move_a
            at_b += move_b
            out += 1
        keep = at_a < last_a
        if not keep.all():
            at_a, at_b, last_a, last_b, out = at_a[keep], at_b[keep], last_a[keep], last_b[keep], out[keep]
    return steps


def links(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A and B token numbers of each link, from the steps of one or of consecutive documents."""
    move_a, move_b = (steps & 1).astype(np.int64), (steps >> 1).astype(np.int64)
    return np.cumsum(move_a) - move_a, np.cumsum(move_b) - move_b


def group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, steps: np.ndarray, n_tokens: list[int]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each of the consecutive documents."""
    cut = steps == 3
    before = np.cumsum(cut) - cut
    group_a, group_b = before[(steps & 1) > 0], before[steps > 1]
    n = int(cut.sum())
    upto_a, upto_b = starts(np.bincount(group_a, minlength=n)), starts(np.bincount(group_b, minlength=n))
    ends_a, ends_b = np.append(group_a[1:] != group_a[:-1], True)[:len(a)], np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + upto_b[group_a]] = pair.a_names[a + ends_a * np.int64(len(pair.a_bytes))]
    out[np.arange(len(b)) + upto_a[group_b + 1]] = pair.b_names[b + ends_b * np.int64(len(pair.b_bytes))]
    at = starts(n_tokens)
    return ["".join(out[i:j].tolist())[:-1] for i, j in zip(at, at[1:])]


def align(df: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, packed), written once.

    ``a`` and ``b`` are paths of a tokenizer JSON file and a sentencepiece model on
    the driver; their bytes travel with the tasks.  ``packed`` holds the A ids, the B
    ids and the steps, compressed; ``unpacked`` reads it.  A text that is NULL or
    empty, or that either tokenizer does not give back, has no tokens, zeros, and
    an empty groups_sha256.  Rows without a key and repeated rows are rows like any other.
    """
    context = df.sparkSession.sparkContext
    files = context.broadcast((Path(a).read_bytes(), Path(b).read_bytes()))
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*files.value)
        for batch in (part for whole in batches for part in sliced(whole, 1, SLICE_BYTES)):
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            a_ids, b_ids = pair.ids(texts)
            n_a, n_b = [len(x) for x in a_ids], [len(x) for x in b_ids]
            a_from, b_from, a_flat, b_flat = starts(n_a), starts(n_b), np.concatenate(a_ids), np.concatenate(b_ids)
            a_ends, b_ends = (np.cumsum(sizes[flat]) for sizes, flat in ((pair.a_length, a_flat), (pair.b_length, b_flat)))
            steps = lockstep(a_ends, b_ends, a_from, b_from)  # ends run on over documents: equal bytes keep both lists in step
            done = starts(steps > 0)
            at = a_from + b_from
            n_links, n_groups = np.diff(done[at]), np.diff(starts(steps == 3)[at])
            shown = group_texts(pair, a_flat, b_flat, steps[steps > 0], [x + y for x, y in zip(n_a, n_b)])
            packed = [pa.compress(x.tobytes() + y.tobytes() + steps[i:i + n].tobytes(), codec="zstd", asbytes=True)
                      for x, y, i, n in zip(a_ids, b_ids, at, n_links)]
            hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
            yield pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)), pa.array(hashes),
                                              pa.array(packed, pa.binary())], schema.replace(",", "").split()[::2])

    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return settle(rows.withColumn("row", F.monotonically_increasing_id()))


def unpacked(packed: bytes, n_a: int, n_b: int, n_links: int, types: tuple[type, type]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ids, B ids and steps of a document."""
    a_size, b_size = n_a * np.dtype(types[0]).itemsize, n_b * np.dtype(types[1]).itemsize
    data = pa.decompress(packed, a_size + b_size + n_links, codec="zstd", asbytes=True)
    return (np.frombuffer(data, types[0], n_a), np.frombuffer(data, types[1], n_b, a_size), np.frombuffer(data, np.uint8, n_links, a_size + b_size))


def id_types(a: str, b: str) -> tuple[type, type]:
    import sentencepiece
    vocabulary = json.loads(Path(a).read_text())
    size = max([*vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary["added_tokens"])]) + 1
    return id_type(size), id_type(sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size())


def _coded(batch: pa.RecordBatch, types: tuple[type, type]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all links of a batch of (n_a, n_b, n_links, packed, ...), and where each row's links start."""
    n_a, n_b, n_links = (batch.column(i).to_pylist() for i in range(3))
    parts = [unpacked(p, x, y, n, types) for p, x, y, n in zip(batch.column(3).to_pylist(), n_a, n_b, n_links)]
    a, b, steps = (np.concatenate([p[i] for p in parts]) for i in range(3))
    i, j = links(a, b, steps)
    return a[i].astype(np.int64) << SHIFT | b[j], starts(n_links)


def pair_counts(aligned: DataFrame, types: tuple[type, type]) -> DataFrame:
    """(pair, n, best): links that hold an id pair, corpus-wide, and whether no pair with this B id has more.

    Tasks send counts of COUNTED links at a time; memory does not grow with the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(codes):
            pairs, n = np.unique(np.concatenate(codes), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n, pa.int64())], ["pair", "n"])

        codes, size = [], 0
        for batch in (part for whole in batches for part in sliced(whole, 3, SLICE_BYTES)):
            codes.append(_coded(batch, types)[0])
            size += len(codes[-1])
            if size > COUNTED:
                yield counted(codes)
                codes, size = [], 0
        if codes:
            yield counted(codes)

    pairs = settle(aligned.select("n_a", "n_b", "n_links", "packed").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    own = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    most = pairs.groupBy(own.alias("_b")).agg(F.max("n").alias("_most"))
    return settle(pairs.withColumn("_b", own).join(most, "_b").select("pair", "n", (F.col("n") == F.col("_most")).alias("best")))


def _frequent(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The pairs above the smallest power of two that leaves TOP at most, ordered, with counts; and whether these are all."""
    sizes = {r["p"]: r["c"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    power, held = 64, 0
    while power and held + sizes.get(power - 1, 0) <= TOP:
        power -= 1
        held += sizes.get(power, 0)
    table = pairs.filter(F.floor(F.log2("n")) >= power).orderBy("pair").toArrow()
    found = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    return found[0], found[1], found[2], power == 0


def score(aligned: DataFrame, types: tuple[type, type]) -> DataFrame:
    """Adds n_best and count_sum: links whose pair is the commonest of its B id, and the sum of the links' pair counts."""
    pairs = pair_counts(aligned, types)
    *top, whole = _frequent(pairs)
    shipped = aligned.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shipped.value
        for batch in (part for whole in batches for part in sliced(whole, 3, SLICE_BYTES)):
            codes, at = _coded(batch, types)
            place = np.searchsorted(pairs, codes)
            place[place == len(pairs)] = 0
            known = pairs[place] == codes if len(pairs) else np.zeros(len(codes), bool)
            n, b = (np.where(known, x[place], 0) if len(pairs) else np.zeros(len(codes), np.int64) for x in (counts, best))
            total, n_best = np.diff(starts(n)[at]), np.diff(starts(b)[at])
            rest, ends = codes[~known], starts(~known)[at]
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest))],
                                             ["row", "n_best", "count_sum", "rest"])

    scored = aligned.select("n_a", "n_b", "n_links", "packed", "row").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint, rest array<bigint>")
    if not whole:
        scored = settle(scored)
        more = (scored.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("_times")).join(pairs, "pair")
                .groupBy("row").agg(F.sum(F.col("_times") * F.col("n")).alias("_sum"), F.sum(F.col("_times") * F.col("best").cast("int")).alias("_best")))
        scored = (scored.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
                  .withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0))))
    return aligned.drop("packed").join(scored.select("row", "n_best", "count_sum"), "row").drop("row")
