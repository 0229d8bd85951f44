"""Byte-level BPE with a rank queue.

The queue holds the mergeable pairs of one pre-token: a bucket per merge rank
with the positions where such a pair starts, and a bitmap of two levels, 256 ranks
to a group, over the ranks in use, so that finding the next rank is two
find-first-set steps however long the pre-token is.  Positions are the starts of the parts in a
linked list over the bytes.  Entries are never removed: one whose pair has
changed since is skipped when it comes up.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Callable
from heapq import heappop, heappush
from pathlib import Path
from types import ModuleType

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

#: Encoded pre-tokens a Python worker remembers, over its tasks, before it starts over; it changes the speed only.
REMEMBERED = 600_000

Encoder = Callable[[bytes], list[int]]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Rank by token from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) }


def piece_encoder(ranks: dict[bytes, int]) -> Encoder:
    """The function that encodes one pre-token, given as bytes."""
    rank_of, longest = ranks.get, max(map(len, ranks))
    low = [0] * ((max(ranks.values()) >> 8) + 1)  # bit r of group g: rank g << 8 | r has a bucket
    bits = [1 << i for i in range(max(256, len(low)))]

    def encode(piece: bytes) -> list[int]:
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the pair that starts here, -1 for none
        buckets: dict[int, list[int]] = {}
        top = 0  # bit g: group g has buckets
        for i in range(n - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # ascending, so already a heap
                else:
                    buckets[rank] = [i]
                    low[rank >> 8] |= bits[rank & 255]
                    top |= bits[rank >> 8]
        while top:
            g = (top & -top).bit_length() - 1
            w = low[g]
            rank = g << 8 | (w & -w).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                w &= w - 1
                low[g] = w
                if not w:
                    top &= top - 1
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                found = rank_of(piece[i:after[k]]) if after[k] - i <= longest else None
                if found is not None:
                    pair[i] = found
                    if found in buckets:
                        heappush(buckets[found], i)
                    else:
                        buckets[found] = [i]
                        low[found >> 8] |= bits[found & 255]
                        top |= bits[found >> 8]
            p = before[i]
            if p >= 0:
                found = rank_of(piece[p:k]) if k - p <= longest else None
                if found is None:
                    pair[p] = -1
                else:
                    pair[p] = found
                    if found in buckets:
                        heappush(buckets[found], p)
                    else:
                        buckets[found] = [p]
                        low[found >> 8] |= bits[found & 255]
                        top |= bits[found >> 8]
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:after[i]]])
            i = after[i]
        return out

    return encode


class _Remembered(dict):
    """Packed ids by pre-token."""

    def __init__(self, table: dict[bytes, int]):
        super().__init__()
        self.encode = piece_encoder(table)

    def __missing__(self, word: str) -> bytes:
        packed = array("I", self.encode(word.encode())).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(packed) <= 256:
            self[word] = packed
        return packed


def _remembered(data: bytes, table: dict[bytes, int]) -> _Remembered:
    """The memory of this worker for a rank file; functions are unpickled for each task, a module stays."""
    held = sys.modules.setdefault("_remembered_pieces", ModuleType("_remembered_pieces")).__dict__
    name = hashlib.sha256(data).hexdigest()
    if name not in held:
        held[name] = _Remembered(table)
    return held[name]


def encode(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]) for every row.

    ``ranks`` is the path of a rank file on the driver; its bytes travel with the
    tasks (a vocabulary, well under a megabyte).  ``ids`` are little-endian
    unsigned 32-bit integers; ``decoded`` are the bytes the ids stand for.  A NULL
    or empty text has no ids; rows without a key and repeated rows are encoded like
    any other; other columns are not read.  Work is by row: no shuffle.
    """
    shipped = df.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())

    def start():
        table = parse_ranks(shipped.value)
        tokens = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            tokens[rank] = token
        split, packed_of, bytes_of = regex.compile(pattern).findall, _remembered(shipped.value, table).__getitem__, tokens.__getitem__

        def work(columns: list[list]) -> list[tuple]:
            out = []
            for name, value in zip(*columns):
                ids = b"".join(map(packed_of, split(value or "")))
                row = (name, len(ids) // 4, ids)
                out.append(row + (b"".join(map(bytes_of, array("I", ids))),) if decoded else row)
            return out

        return work

    schema = "doc_id bigint, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return map_rows(df, {"doc_id": F.col(key), "text": F.col(text)}, schema, start)


def decode(df: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded) of packed ids; NULL ids decode to nothing."""
    shipped = df.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())

    def start():
        token_of = {rank: token for token, rank in parse_ranks(shipped.value).items()}.__getitem__
        return lambda columns: [(name, b"".join(map(token_of, array("I", packed or b"")))) for name, packed in zip(*columns)]

    return map_rows(df, {"doc_id": F.col(key), "ids": F.col(ids)}, "doc_id bigint, decoded binary", start)
