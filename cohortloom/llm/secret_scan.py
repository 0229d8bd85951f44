"""Secret scans in column expressions.

Three fixed patterns give the base spans.  On top, candidate strings are scored
by the largest Shannon entropy of a sliding window over their characters, with
the counts of the window kept up as it moves; what an allow list explains is
suppressed.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # runs of at least 24: the same matches as dropping shorter runs
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Smallest entropy in bits of the best window, by the narrowest class that holds the whole candidate.
#: All digits are numbers (ALLOWED), so digits have no limit; letters of one case are mostly words.
LIMITS = {"hexadecimal": 3.0, "letters": 3.9, "cased": 3.5, "mixed": 3.5}
#: Candidates that are something else: numbers and dates, UUIDs.
ALLOWED = ("^[0-9_=+/-]*$", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
#: What words, paths and joined words do not have: digits, and capitals inside a word without three letters of it.
UNLIKE_WORDS = "[0-9]|[a-z][A-Z](?![a-z]{2})|[A-Z]{2}[a-z](?![a-z]{2})"
ONE_CASE = "^[a-z]+$|^[A-Z]+$"
KINDS = ("assign", "access", "hex", "entropy")
_MARK, _OTHER = "\x01", "\x02"
SPAN = "array<struct<start:bigint,kind:int,stop:bigint,value:string>>"


def _marked(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern as (start, kind, stop, value).

    Each match is set between two marks, the text is split at the marks, and the
    odd pieces are the matches; lengths add up to offsets.  The mark is replaced
    in the text beforehand: no pattern here can match it or its stand-in.
    """
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)

    def step(state: Column, piece: Column) -> Column:
        stop = state["at"] + F.length(piece)
        found = F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), piece.alias("value"))
        return F.struct(stop.alias("at"), (~state["inside"]).alias("inside"),
                        F.when(state["inside"], F.concat(state["spans"], F.array(found))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("spans"))
    spans = F.when(F.size(pieces) > 1, F.aggregate(pieces, start, step, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))
    return spans


def window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``window`` successive characters (of all, in a shorter string).

    H = log2(w) - sum(c log2 c)/w; moving on by one character changes two counts,
    so the sum is kept up by their differences.
    """
    width = F.least(F.length(value), F.lit(window))
    chars = F.split(value, "")
    # each character with the one that leaves the window when it arrives; lambdas see only these and the state
    moves = F.arrays_zip(chars.alias("arriving"), F.concat(F.array_repeat(F.lit(None).cast("string"), width), chars).alias("leaving"))

    def term(count: Column) -> Column:
        return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))

    def count_of(counts: Column, char: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, char), F.lit(0))

    def put(counts: Column, char: Column, count: Column) -> Column:
        return F.map_concat(F.map_filter(counts, lambda k, _: k != char), F.map_from_arrays(F.array(char), F.array(count)))

    def leave(counts: Column, total: Column, char: Column) -> tuple[Column, Column]:
        n = count_of(counts, char)
        return (F.when(char.isNotNull(), put(counts, char, n - 1)).otherwise(counts),
                F.when(char.isNotNull(), total + term(n - 1) - term(n)).otherwise(total))

    def step(state: Column, move: Column) -> Column:
        n = count_of(state["counts"], move["arriving"])
        counts, total = leave(put(state["counts"], move["arriving"], n + 1), state["total"] + term(n + 1) - term(n), move["leaving"])
        seen = state["seen"] + 1
        best = F.when(seen >= state["width"], F.greatest(state["best"], F.log2(state["width"]) - total / state["width"])).otherwise(state["best"])
        return F.struct(counts.alias("counts"), total.alias("total"), best.alias("best"), seen.alias("seen"), state["width"].alias("width"))

    start = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("counts"),
                     F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("seen"), width.alias("width"))
    return F.when(width > 0, F.aggregate(F.slice(moves, F.lit(1), F.length(value)), start, step, lambda s: s["best"])).otherwise(0.0)


def _limit(value: Column) -> Column:
    return (F.when(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), LIMITS["hexadecimal"]).when(value.rlike(ONE_CASE), LIMITS["letters"])
            .when(value.rlike("^[A-Za-z]+$"), LIMITS["cased"]).otherwise(LIMITS["mixed"]))


def _suspicious(value: Column) -> Column:
    allowed = ~value.rlike(UNLIKE_WORDS) & ~value.rlike(ONE_CASE)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, False).otherwise(window_entropy(value) >= _limit(value))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): arrays of spans (start, kind, stop, value) for every row, in order of start, then kind.

    ``base`` holds the spans of the fixed patterns, ``found`` also those that only
    the entropy of a candidate gives; a candidate that overlaps a base span is
    left to it.  A NULL or empty text has no spans; rows without a key and
    repeated rows are scanned like any other.  Other columns are not read.
    Everything runs in column expressions on the row itself: no shuffle.
    """
    source = df.select(F.col(key).alias("doc_id"), F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _OTHER).alias("_text"))
    assigned = F.filter(_marked(F.col("_text"), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6)
    access = F.filter(_marked(F.col("_text"), ACCESS, 1), lambda s: F.length(s["value"]) >= 20)
    spans = source.select(
        "doc_id", assigned.alias("_assign"), access.alias("_access"), _marked(F.col("_text"), HEX, 2).alias("_hex"),
        F.filter(_marked(F.col("_text"), CANDIDATE, 3), lambda s: _suspicious(s["value"])).alias("_more"))
    based = spans.select("doc_id", F.array_sort(F.concat("_assign", "_access", "_hex")).alias("base"), "_more")
    fresh = F.filter("_more", lambda s: ~F.exists("base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))
    return based.select("doc_id", "base", F.array_sort(F.concat("base", fresh)).alias("found"))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
