"""Random draws as pure functions of (seed, purpose, replicate, key).

A draw does not depend on partitioning or task retries, and plain SQL can
recompute it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = float(2 ** 60)


def draw(seed: int, purpose: str, *keys: Column) -> Column:
    """A uniform 60-bit integer keyed by its arguments."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def draw_sql(seed: int, purpose: str, *keys: str) -> str:
    """The same integer in DuckDB."""
    parts = ",".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"CAST('0x'||substr(md5(concat_ws('|','{seed}','{purpose}',{parts})),1,15) AS BIGINT)"


_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK, _TOGETHER = 55, 1 << 15  # longest text of one md5 block, and draws that stay in the cache together


Texts = list[tuple[int, np.ndarray, np.ndarray]]


def by_length(texts: Sequence[str] | pa.Array) -> Texts:
    """Texts of equal length as (length in bytes, places, bytes by row): what ``draw_grid`` takes for texts it meets often."""
    column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data, lengths = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8), np.diff(ends)
    return [(int(n), at, data[ends[at][:, None] + np.arange(n)]) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]]


def draw_grid(heads: Sequence[str], tails: Sequence[str] | Texts) -> np.ndarray:
    """heads x tails: the 60-bit draw of the text head + tail, as ``draw`` has it.

    md5 runs on whole arrays, one block of texts of equal length at a time.
    """
    rows, columns = by_length(heads), tails if tails and isinstance(tails[0], tuple) else by_length(tails)
    out = np.empty((len(heads), sum(len(at) for _, at, _ in columns)), np.uint64)
    for h, at_h, head in rows:
        for t, at_t, tail in columns:
            if h + t > _ONE_BLOCK:
                texts = [hashlib.md5(a.tobytes() + b.tobytes()).digest()[:8] for a in head for b in tail]
                out[np.ix_(at_h, at_t)] = (np.frombuffer(b"".join(texts), ">u8") >> np.uint64(4)).reshape(len(head), -1)
                continue
            wide = min(len(tail), max(4096, _TOGETHER // len(head)))
            high = max(1, _TOGETHER // wide)
            for i in range(0, len(head), high):
                for j in range(0, len(tail), wide):
                    out[np.ix_(at_h[i:i + high], at_t[j:j + wide])] = _md5_grid(head[i:i + high], tail[j:j + wide])
    return out


def _md5_grid(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """First 60 bits of md5 of every head + tail, at most 55 bytes long."""
    h, t = heads.shape[1], tails.shape[1]

    def padded(parts: np.ndarray, at: int) -> np.ndarray:
        block = np.zeros((len(parts), 64), np.uint8)
        block[:, at:at + parts.shape[1]] = parts
        return block

    left, right = padded(heads, 0), padded(tails, h)
    right[:, h + t] = 128
    left, right = left.view("<u4").astype(np.uint32), right.view("<u4").astype(np.uint32)
    right[:, 14] = (h + t) * 8
    words = []
    for i in range(16):
        x, y = left[:, i, None], right[None, :, i]
        words.append((x[:1] if (x == x[0]).all() else x) | (y[:, :1] if (y == y[0, 0]).all() else y))
    shape = (len(heads), len(tails))
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[_WORDS[i]] + np.uint32(_SINES[i])
        np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        f |= turned
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4))
