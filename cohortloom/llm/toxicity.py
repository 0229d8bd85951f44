"""Toxicity by noisy-channel deobfuscation.

A token with look-alike characters, stretched letters or letters set apart is a
lattice of the words it may stand for; Viterbi decoding under a character
trigram model of the whole corpus picks one.  The restored words are scored by
how toxic the labelled documents are that hold the same words or word pieces;
the cut is the one that tells these documents apart best when each is judged by
the others.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .rows import map_rows, remainder

HELD_OUT_PARTS = 5
#: Labelled rows the scorer is fitted on at most: those with the smallest hash of the key.
MAX_LABELLED = 20_000
#: Pieces of words the scorer keeps at most, by their toxic rate.
MAX_PIECES = 50_000
PRIOR = 4.0  # labelled rows of the overall rate that a piece's counts are mixed with
EVIDENCE = 2  # pieces of a text, the strongest, whose log odds are added up
LEAST_RATE = 0.25  # pieces below say nothing on their own
NEAR = 0.5  # word triples that near copies share at least, as a part of all theirs
THRESHOLD = 0.5
STEMS = (4, 5, 6)  # letters of the beginnings of words that count as pieces

#: Letters that a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "(": "c", "€": "e"}
SUBSTITUTED, COLLAPSED, DROPPED = -1.0, -0.5, -6.0  # log weights of the channel

LETTERS = 28  # edge, a-z, any other letter
_CODE = np.zeros(256, np.int64)
_CODE[ord("a"):ord("z") + 1] = _CODE[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_CODE[128:] = 27


# ---------------------------------------------------------------- language model


def trigram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts; each task sends at most one row per trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS ** 3, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                joined = "  ".join(t for t in batch.column(0).slice(i, 64).to_pylist() if t)
                code = _CODE[np.frombuffer(f"  {joined}  ".encode(), np.uint8)]
                total += np.bincount((code[:-2] * LETTERS + code[1:-1]) * LETTERS + code[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])

    found = (df.select(F.col(text).alias("text")).mapInArrow(count, "trigram bigint, n bigint")
             .groupBy("trigram").agg(F.sum("n").alias("n")).collect())  # at most LETTERS**3 rows
    counts = np.zeros(LETTERS ** 3)
    for row in found:
        counts[row.trigram] = row.n
    return counts


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a b), trigrams smoothed by bigrams and these by letters."""
    tri = counts.reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return np.log((tri + 5 * p2) / (tri.sum(2, keepdims=True) + 5))


def _code(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27


def restore(token: str, model: list) -> str:
    """The likeliest word behind a lower-case token.

    Lattice: a letter is itself; three or more of the same letter may be one or
    two; a look-alike is one of its letters or, at a price, nothing; anything else
    is nothing.  ``model`` is ``log_model`` as nested lists.
    """
    paths = {(0, 0): (0.0, "")}
    runs, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        runs.append((token[i], j - i))
        i = j
    for char, n in runs:
        letters = LOOKALIKES.get(char)
        if char.isalpha():
            ways = [(char * n, 0.0)] if n < 3 else [(char, COLLAPSED), (char * 2, COLLAPSED)]
        elif letters:
            ways = [(x * min(n, 2), SUBSTITUTED * min(n, 2)) for x in letters] + [("", DROPPED)]
            if n > 1:
                ways += [(x, SUBSTITUTED) for x in letters]
            if n == 2 and len(letters) > 1:
                ways += [(x + y, 2 * SUBSTITUTED) for x in letters for y in letters if x != y]
        else:
            continue
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in paths.items():
            for letters_, weight in ways:
                p, q, s = a, b, score + weight
                for x in letters_:
                    c = _code(x)
                    s += model[p][q][c]
                    p, q = q, c
                if (p, q) not in new or new[p, q][0] < s:
                    new[p, q] = (s, word + letters_)
        paths = new
    return max((s + model[a][b][0], w) for (a, b), (s, w) in paths.items())[1]


# ---------------------------------------------------------------- words of a text

_SPACED = re.compile(r"(?<![^\W_])[A-Za-z0-9@$!|]([ ._*-])[A-Za-z0-9@$!|](?:\1[A-Za-z0-9@$!|])+(?![^\W_])")
_ODD = re.compile(r"[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")


def word_of(token: str, model: list) -> str:
    """The restored word of a raw token; "" without letters."""
    lower = token.lower()
    core = lower.strip(".,;:?\"'`~#%^&*()[]{}<>/\\=_-")
    if core.isalpha() and not _STRETCHED.search(core):
        return core
    if not _ODD.search(core):
        return ""
    core = core.rstrip("!|$+") or core  # closing marks
    if core.isalpha() and not _STRETCHED.search(core):
        return core
    return restore(core, model)


def spaced_words(text: str) -> list[str]:
    """Runs of single characters set apart by one separator each, drawn together; also without a first or last
    letter, which may be a word of its own."""
    drawn = [w for w in (m[0][::2] for m in _SPACED.finditer(text)) if _ODD.search(w)]
    return [v for w in drawn for v in ((w, w[1:], w[:-1], w[1:-1]) if len(w) > 3 else (w,))]


def pieces(word: str) -> list[str]:
    """The word, marked at its end, and its beginnings."""
    return [f"{word}$"] + [word[:n] for n in STEMS if n < len(word)]


# ---------------------------------------------------------------- scorer


def weights(counts: dict[str, tuple[int, int]], overall: float, own: int | None = None) -> dict[str, float]:
    """Log odds that pieces with (clean, toxic) rows add to the overall rate; ``own``: without a row of that label itself."""
    out = {}
    for piece, (clean, toxic) in counts.items():
        clean, toxic = clean - (own == 0), toxic - (own == 1)
        rate = (toxic + PRIOR * overall) / (toxic + clean + PRIOR)
        if toxic > 0 and rate > overall:
            out[piece] = logit(rate) - logit(overall)
    return out


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def best_cut(judged: list[tuple[float, int]], least: float) -> float:
    """The cut over ``least`` with the fewest errors on (evidence, label) rows; of equally good ones, and in the gap
    between two rows, the nearest to even odds that keeps a quarter of the gap to both."""
    rows = sorted(judged)
    values = [least] + [v for v, _ in rows]
    errors, best = sum(1 - label for _, label in rows), (math.inf, 0.0, least)
    for i, low in enumerate(values):
        if i:
            errors += 2 * rows[i - 1][1] - 1
        high = values[i + 1] if i + 1 < len(values) else max(low, 0.0) + 2
        if high > low >= least:
            room = (high - low) / 4
            cut = min(max(0.0, low + room), high - room)
            best = min(best, (errors, abs(cut), cut))
    return best[2]


def triples(text: str) -> set[int]:
    words = text.split()
    return {zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))}


#: Odd factors: each gives another order of the triples, and so another minimal hash.
_ORDERS = (1, 2654435761, 2246822519, 3266489917)


def _minima():
    return lambda columns: [(text, label, [min(c * o % 2 ** 32 for c in codes) for o in _ORDERS])
                            for text, label in zip(*columns) for codes in (triples(text),)]


def _apart():
    def far(a: str, b: str) -> bool:
        one, two = triples(a), triples(b)
        return len(one & two) < NEAR * len(one | two)

    return lambda columns: [(t, label, m) for t, label, m, first in zip(*columns) if t == first or far(t, first)]


def without_copies(texts: DataFrame) -> DataFrame:
    """Of (text, label), equal texts once, with their largest label, and of near copies one.

    Texts that share a minimal hash of their word triples, in any of several
    orders, are compared with the group's first (toxic before clean), and go only
    if they share NEAR of all triples with it.
    """
    ddl = "text string, label int, minima array<bigint>"
    rows = texts.groupBy("text").agg(F.max("label").alias("label"))
    rows = settle(map_rows(rows, {c: F.col(c) for c in ("text", "label")}, ddl, _minima))
    for i in range(len(_ORDERS)):
        rows = rows.withColumn("same", F.col("minima")[i])
        first = (rows.groupBy("same").agg(F.max(F.struct("label", "text")).alias("first"), F.count(F.lit(1)).alias("n"))
                 .filter("n > 1").select("same", F.col("first.text").alias("first")))
        joined = rows.join(first, "same", "left").withColumn("first", F.coalesce("first", "text"))
        rows = settle(map_rows(joined, {c: F.col(c) for c in ("text", "label", "minima", "first")}, ddl, _apart))
    return rows.select("text", "label")


def labelled_sample(labels: DataFrame, label: str, parts: int, left_out: int, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled keys outside the held-out part, by hash of the key; one row per key."""
    return (labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (remainder(F.col(key), parts) != left_out))
            .groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
            .orderBy(F.xxhash64("key"), "key").limit(most))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> dict:
    """The language model, the labelled rows that hold each word piece, the overall rate and the cut.

    The language model counts all texts.  The counts come from at most
    MAX_LABELLED labelled rows (a set small enough to broadcast by that bound),
    near copies once, so that a copied text cannot make its own words look toxic.
    Whole words are judged first; the beginnings of words that are toxic by
    themselves are not counted, so they cast no suspicion on other words that
    begin alike.  The cut is chosen on the same rows, each judged by the counts
    without itself.  Without labels the overall rate is 0 and nothing is toxic.
    """
    model = log_model(trigram_counts(df, text))
    shipped = df.sparkSession.sparkContext.broadcast(model)
    sample = labelled_sample(labels, "toxic", HELD_OUT_PARTS, 0, MAX_LABELLED)
    texts = (df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
             .join(F.broadcast(sample), "key").select("text", "label"))
    texts = without_copies(texts)

    def counter(explained: frozenset[str], whole: bool):
        def start():
            table = shipped.value.tolist()
            known: dict[str, list[str]] = {}

            def pieces_of(token: str) -> list[str]:
                word = word_of(token, table)
                if not word or f"{word}$" in explained:
                    return []
                return pieces(word)[:1] if whole else pieces(word)[1:]

            def work(columns: list[list]) -> list[tuple]:
                counts: dict[str, list[int]] = {"": [0, 0]}
                for value, label in zip(*columns):
                    found = {""}
                    for token in value.split() + spaced_words(value):
                        if token not in known:
                            if len(known) >= 100_000:
                                known.clear()
                            known[token] = pieces_of(token)
                        found.update(known[token])
                    for piece in found:
                        counts.setdefault(piece, [0, 0])[label] += 1
                return [(p, clean, toxic) for p, (clean, toxic) in counts.items()]

            return work

        return start

    def counted(explained: frozenset[str], whole: bool) -> dict[str, tuple[int, int]]:
        counts = (map_rows(texts, {"text": F.col("text"), "label": F.col("label")}, "piece string, clean bigint, toxic bigint",
                           counter(explained, whole))
                  .groupBy("piece").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
        n = F.col("toxic") + F.col("clean")
        counts = counts.filter((F.col("toxic") > LEAST_RATE * n) & (F.col("toxic") > 1) | (F.col("piece") == ""))
        found = counts.orderBy((F.col("piece") == "").desc(), (F.col("toxic") / (n + PRIOR)).desc(), "piece").limit(MAX_PIECES).collect()
        return {r.piece: (r.clean, r.toxic) for r in found}

    words = counted(frozenset(), True)
    clean, toxic = words.pop("", (0, 0))
    overall = (toxic + 0.5) / (clean + toxic + 1) if clean + toxic else 0.0
    stems = counted(frozenset(w for w, (c, t) in words.items() if (t + PRIOR * overall) / (c + t + PRIOR) >= THRESHOLD), False)
    stems.pop("", None)
    fitted = {"model": model, "counts": words | stems, "overall": overall, "cut": 0.0}
    if overall:
        told = df.sparkSession.sparkContext.broadcast(fitted)

        def judge():
            scorers = [Scorer(told.value, own) for own in (0, 1)]
            return lambda columns: [(scorers[label].evidence(value), label) for value, label in zip(*columns)]

        judged = map_rows(texts, {"text": F.col("text"), "label": F.col("label")}, "evidence double, label int", judge).collect()  # MAX_LABELLED rows
        fitted["cut"] = best_cut([(r.evidence, r.label) for r in judged], logit(overall))
    return fitted


class Scorer:
    """Scores of texts; what tokens are worth is remembered.  ``own``: the label of fit rows that are judged without themselves."""

    def __init__(self, fitted: dict, own: int | None = None):
        self.model, self.overall, self.cut = fitted["model"].tolist(), fitted["overall"], fitted["cut"]
        self.weights = weights(fitted["counts"], self.overall, own) if self.overall else {}
        self.base = logit(self.overall) if self.overall else -math.inf
        self.known: dict[str, tuple[float, str]] = {}

    def worth(self, token: str) -> tuple[float, str]:
        """The strongest piece of the restored word, after its log odds."""
        word = word_of(token, self.model)
        return max(((self.weights.get(p, 0.0), p) for p in pieces(word)), default=(0.0, "")) if word else (0.0, "")

    def evidence(self, text: str) -> float:
        """Log odds of the overall rate and of the text's strongest pieces, each counted once."""
        known, found = self.known, {}
        for token in text.split() + spaced_words(text):
            value = known.get(token)
            if value is None:
                if len(known) >= 200_000:
                    known.clear()
                value = known[token] = self.worth(token)
            if value[0]:
                found[value[1]] = value[0]
        return self.base + sum(sorted(found.values())[-EVIDENCE:])

    def __call__(self, text: str) -> float:
        """The evidence as a probability, moved so that the cut is at THRESHOLD, 0.5."""
        return 1 / (1 + math.exp(min(700.0, self.cut - self.evidence(text))))


def score(df: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; 0 to 1, higher: likelier toxic.

    A NULL or empty text is not toxic; rows without a key and
    repeated rows are scored like any other; other columns are not read.  Work is
    by row: no shuffle; the fitted tables are bounded and broadcast.
    """
    shipped = df.sparkSession.sparkContext.broadcast(fitted)

    def start():
        scorer = Scorer(shipped.value)
        return lambda columns: [(name, scorer(value or "")) for name, value in zip(*columns)]

    return map_rows(df, {"doc_id": F.col(key), "text": F.col(text)}, "doc_id bigint, score double", start)


def kept(df: DataFrame, fitted: dict, text: str = "text") -> DataFrame:
    """The rows whose text is not toxic, with all their columns; a NULL text is kept."""
    shipped, schema = df.sparkSession.sparkContext.broadcast(fitted), df.schema
    place = df.columns.index(text)

    def start():
        scorer = Scorer(shipped.value)
        return lambda columns: [row for row in zip(*columns) if scorer(row[place] or "") < THRESHOLD]

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return map_rows(df, {c: F.col(f"`{c}`") for c in df.columns}, ddl, start)
