"""Quality by nearest-neighbour voting in a latent semantic space.

Documents are bags of hashed character triples and token shapes, weighted by
log counts and inverse document frequency over the whole corpus.  Directions
come from a singular value decomposition of a bounded labelled sample; the
sample's vectors are broadcast, every document is compared with all of them by
blocked matrix products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .rows import map_rows
from .toxicity import labelled_sample

HELD_OUT_PARTS, HELD_OUT = 4, 2
TERMS = 2048
#: Labelled rows in the voting table at most: those with the smallest hash of the key.
MAX_LABELLED = 4_000
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8  # similarities vote with this power
THRESHOLD = 0.7

_SHAPES = (("upper", re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b")), ("marks", re.compile(r"[^\w\s.,]{2,}")), ("bar", re.compile(r"\|")),
           ("digits", re.compile(r"\d+")), ("lines", re.compile(r"\n")), ("title", re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿ]")), ("stop", re.compile(r"\.")))
SHAPE_TERMS, SHAPE_COUNT, SHAPE_WEIGHT = 256, 40, 3.0  # shapes count as often in every text and are not weighted by rarity
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[ord("0"):ord("9") + 1] = ord("0")


def term_counts(text: str) -> np.ndarray:
    """Counts of hashed terms: character triples of the bytes, and token shapes by their share of the words."""
    counts = np.zeros(TERMS, np.float32)
    code = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    if len(code) >= 3:
        triples = (code[:-2] * 65_599 + code[1:-1]) * 65_599 + code[2:]
        counts[SHAPE_TERMS:] = np.bincount((triples * 0x1E3779B97F4A7C15 >> 20 & 0x7FFFFFFF) % (TERMS - SHAPE_TERMS), minlength=TERMS - SHAPE_TERMS)
    words = text.split()
    found = [(name, len(pattern.findall(text))) for name, pattern in _SHAPES]
    found.append(("repeat", sum(map(str.__eq__, words, words[1:]))))
    for name, n in found:
        share = min(7, int(8 * n / max(1, len(words))))
        counts[zlib.crc32(f"{name}{share}".encode()) % SHAPE_TERMS] += SHAPE_COUNT
    return counts


def vector(text: str) -> np.ndarray:
    return np.log1p(term_counts(text))


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and documents with each term; all texts count, each task sends at most one row per term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total[:TERMS] += term_counts(value.as_py() or "") > 0
                total[TERMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], names=["term", "n"])

    out = np.zeros(TERMS + 1)
    for row in df.select(F.col(text).alias("text")).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return int(out[TERMS]), out[:TERMS]


def directions(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(seed).normal(size=(x.shape[0], min(rank + 16, *x.shape))).astype(x.dtype))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :rank]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """Projection, voting vectors and labels, from at most MAX_LABELLED labelled rows outside the held-out part.

    The sample is bounded, so it may be broadcast and its vectors brought to the
    driver; document frequencies count every text.  Equal texts vote once.
    """
    n, found = document_frequencies(df, text)
    idf = (np.log((1 + n) / (1 + found)) + 0.05).astype(np.float32)
    idf[:SHAPE_TERMS] = SHAPE_WEIGHT
    sample = labelled_sample(labels, "quality", HELD_OUT_PARTS, HELD_OUT, MAX_LABELLED)
    texts = (df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "key")
             .groupBy(F.sha2("text", 256).alias("same")).agg(F.max(F.struct("text", "label")).alias("r")).select("same", "r.*"))

    def start():
        return lambda columns: [(s, vector(t).astype(np.float16).tobytes(), y) for s, t, y in zip(*columns)]

    rows = settle(map_rows(texts, {"same": F.col("same"), "text": F.col("text"), "label": F.col("label")},
                           "same string, v binary, label int", start)).orderBy("same").collect()  # MAX_LABELLED rows of 4 kB
    if not rows:
        return {"project": np.zeros((TERMS, 1), np.float32), "votes": np.zeros((1, 1), np.float32), "labels": np.array([0.5], np.float32)}
    x = _unit(np.stack([np.frombuffer(r.v, np.float16) for r in rows]).astype(np.float32) * idf)
    project = (idf[:, None] * directions(x, DIMENSIONS)).astype(np.float32)
    raw = np.stack([np.frombuffer(r.v, np.float16) for r in rows]).astype(np.float32)
    return {"project": project, "votes": _unit(raw @ project), "labels": np.array([r.label for r in rows], np.float32)}


def votes(vectors: np.ndarray, fitted: dict) -> np.ndarray:
    """Scores of term vectors: cosine with every voting vector, then the nearest vote by similarity."""
    similar = _unit(vectors @ fitted["project"]) @ fitted["votes"].T
    k = min(NEIGHBOURS, similar.shape[1])
    near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(similar, near, 1), 0) ** SHARPNESS
    overall = fitted["labels"].mean()
    return np.clip(((weight * fitted["labels"][near]).sum(1) + 1e-3 * overall) / (weight.sum(1) + 1e-3), 0, 1)


def score(df: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; 0 to 1, higher: likelier good.

    A NULL or empty text has its shape terms only and is voted on like any other;
    without labels every score is 0.5.  Rows without a key and repeated rows are
    scored; other columns are not read.  Work is by row: no shuffle; what is
    broadcast is bounded by MAX_LABELLED, TERMS and DIMENSIONS.
    """
    shipped = df.sparkSession.sparkContext.broadcast(fitted)

    def start():
        own = shipped.value

        def work(columns: list[list]) -> list[tuple]:
            out = votes(np.stack([vector(t or "") for t in columns[1]]), own) if columns[1] else []
            return [(name, float(s)) for name, s in zip(columns[0], out)]

        return work

    return map_rows(df, {"doc_id": F.col(key), "text": F.col(text)}, "doc_id bigint, score double", start)
