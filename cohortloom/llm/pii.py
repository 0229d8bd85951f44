"""Personal data: fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans.  The field labels whitespace tokens from their
word shapes and those of their neighbours; it is trained here from a small
labelled table and finds forms the patterns miss (bracketed e-mail addresses,
phone numbers without a country code, IPv6 addresses, dotted card numbers).
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
Span = tuple[int, int, int]  # kind, start, stop
Sentence = list[tuple[str, str]]  # token, label

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match cannot start inside a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test; linear in the text."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        if at >= free:
            left = text[free:at]  # holds no @ of an earlier try: ``free`` is past it
            start = at - len(left) + len(left.rstrip(_LOCAL))
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            free = domain.end() if domain else at + 1
            if domain:
                found.append((0, start, free))
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return found
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text)
              if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- features

_CLASS = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_LETTERS, _DIGITS = re.compile("[xX]+"), re.compile("d{5,}")
_TRAIL = ".,;:!?\"'"


def shape(token: str) -> str:
    """Letters fall together, digits keep their number up to four, other characters stay; long shapes are cut to their kind."""
    core = token.strip("\"'").rstrip(_TRAIL) or token
    if core.isalpha():
        return "x"
    out = _DIGITS.sub("D", _LETTERS.sub("x", core.translate(_CLASS)))
    return out if len(out) <= 40 else "long"


def coarse(shape_: str) -> str:
    digits, letters = ("d" in shape_ or "D" in shape_), "x" in shape_
    marks = "".join(sorted({c for c in shape_ if c in "@:()[]-."}))
    return f"{'d' * digits}{'x' * letters}{marks}" if shape_ != "long" else "long"


def labelled_table(seed: int = 7, copies: int = 60) -> list[Sentence]:
    """A small labelled table written out from forms: personal data in its usual spellings, and look-alikes that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    group = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(2, 4)))
    forms = [
        ("email", lambda: f"{word()} [at] {word()} [dot] com"), ("email", lambda: f"{word()} (at) {word()} (dot) org"),
        ("email", lambda: f"{word()}[at]{word()}.com"), ("email", lambda: f"{word()}(at){word()}.net"),
        ("email", lambda: f"{word()}.{number(2)}@{word()}.{word()}.com"), ("email", lambda: f"{word()}@{word()}.com"),
        ("ip", lambda: ".".join(number(rng.randint(2, 3)) for _ in range(4))), ("ip", lambda: ":".join(group() for _ in range(8))),
        ("ip", lambda: f"{group()}:{group()}::{group()}"),
        ("card", lambda: ".".join(number(4) for _ in range(4))), ("card", lambda: "/".join(number(4) for _ in range(4))),
        ("phone", lambda: f"({number(3)}) {number(3)}-{number(4)}"), ("phone", lambda: f"{number(3)}-{number(3)}-{number(4)}"),
        ("phone", lambda: f"{number(3)}.{number(3)}.{number(4)}"), ("phone", lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}"),
        ("other", lambda: number(rng.randint(1, 4))), ("other", lambda: number(16)), ("other", lambda: f"{number(1)}.{number(1)}."),
        ("other", lambda: f"{number(4)}-{number(2)}-{number(2)}"), ("other", lambda: f"{number(2)}:{number(2)}"),
        ("other", lambda: f"{number(2)}.{number(2)}"), ("other", lambda: f"{number(4)}-{number(4)}"), ("other", lambda: f"({number(4)})"),
        ("other", lambda: f"{word()}={number(2)}{word()}{number(4)}"), ("other", lambda: f"({word()})"), ("other", lambda: f"[{word()}]"),
        ("other", lambda: f"{word()}-{word()}"), ("other", lambda: f"{word()}$$$"), ("other", lambda: f"{word()}!!"), ("other", lambda: "|"),
        ("other", lambda: f"v{number(1)}.{number(1)}.{number(1)}"), ("other", lambda: f"{word()}://{word()}.com/{word()}"),
    ]
    table = []
    for label, form in forms:
        for _ in range(copies):
            plain = lambda n: [(word(), "other") for _ in range(n)]
            table.append(plain(rng.randint(1, 4)) + [(t, label) for t in form().split(" ")] + plain(rng.randint(1, 4)))
    return table


# ---------------------------------------------------------------- the field


class Field:
    """Weights of shapes (own, previous, next), of coarse shapes and of label pairs."""

    def __init__(self, shapes: list[str]):
        self.number = {"": 0} | {s: i + 1 for i, s in enumerate(shapes)}  # 0: edge or unknown
        kinds = sorted({coarse(s) for s in shapes} - {""})
        self.kind_number = {"": 0} | {s: i + 1 for i, s in enumerate(kinds)}
        k = len(LABELS)
        self.own, self.previous, self.next = (np.zeros((len(self.number), k)) for _ in range(3))
        self.kind = np.zeros((len(self.kind_number), k))
        self.move = np.zeros((k, k))

    def codes(self, token: str) -> tuple[int, int]:
        s = shape(token)
        return self.number.get(s, 0), self.kind_number.get(coarse(s), 0)

    def scores(self, own: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Label scores of tokens laid end to end; ``first`` and ``last`` mark where documents start and stop."""
        before, after = np.roll(own, 1), np.roll(own, -1)
        before[first], after[last] = 0, 0
        return self.own[own] + self.kind[kind] + self.previous[before] + self.next[after]

    def parts(self) -> list[np.ndarray]:
        return [self.own, self.previous, self.next, self.kind, self.move]


def train(table: Iterable[Sentence], rounds: int = 150, rate: float = 0.2, decay: float = 2e-3) -> Field:
    """Maximum likelihood with an L2 penalty by adaptive gradient steps; forward-backward over all sentences at once."""
    table = list(table)
    field = Field(sorted({shape(t) for s in table for t, _ in s}))
    n, longest, k = len(table), max(map(len, table)), len(LABELS)
    own, kind = np.zeros((n, longest + 2), int), np.zeros((n, longest + 2), int)
    gold, there = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, sentence in enumerate(table):
        for j, (token, label) in enumerate(sentence):
            own[i, j + 1], kind[i, j + 1] = field.codes(token)
            gold[i, j], there[i, j] = LABELS.index(label), True
    me, kinds, before, after = own[:, 1:-1], kind[:, 1:-1], own[:, :-2], own[:, 2:]
    hot = np.eye(k)[gold] * there[..., None]
    squares = [np.full_like(p, 1e-8) for p in field.parts()]
    for _ in range(rounds):
        emit = field.own[me] + field.kind[kinds] + field.previous[before] + field.next[after]
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + field.move, axis=1) + emit[:, t]
            alpha[:, t] = np.where(there[:, t, None], step, alpha[:, t - 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        moves, gold_moves = np.zeros((k, k)), np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[:, t + 1]
            step = np.logaddexp.reduce(field.move + ahead[:, None, :], axis=2)
            beta[:, t] = np.where(there[:, t + 1, None], step, beta[:, t + 1])
            pairs = np.exp(alpha[:, t, :, None] + field.move + ahead[:, None, :] - total[:, None, None])
            moves += (pairs * there[:, t + 1, None, None]).sum(0)
            gold_moves += np.einsum("ni,nj->ij", hot[:, t], hot[:, t + 1])
        error = hot - np.exp(alpha + beta - total[:, None, None]) * there[..., None]
        gradients = []
        for p, index in zip(field.parts(), (me, before, after, kinds)):
            g = np.zeros_like(p)
            np.add.at(g, index, error)
            gradients.append(g)
        field_parts = field.parts()
        for p, g, s in zip(field_parts, [*gradients, gold_moves - moves], squares):
            g = g / n - decay * p / 10
            s += g * g
            p += rate * g / np.sqrt(s)
        for p in field_parts[1:3]:
            p[0] = 0.0  # an edge or an unknown shape says nothing
        field.own[0] = field.kind[0] = 0.0
    return field


def viterbi(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of sequences laid end to end that start and end next to ``other``; a batch advances one token a step."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    sizes, begin = lengths[order], starts[order]
    labels = np.zeros(len(scores), np.int8)
    if not len(lengths):
        return labels
    best = move[0] + scores[begin]
    back = np.zeros(scores.shape, np.int8)
    for t in range(1, int(sizes[0])):
        m = int(np.searchsorted(-sizes, -t, side="left"))  # sequences longer than t
        paths = best[:m, :, None] + move
        back[begin[:m] + t] = paths.argmax(1)
        best[:m] = paths.max(1) + scores[begin[:m] + t]
    label = (best + move[:, 0]).argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        labels[begin[:m] + t] = label[:m]
        label[:m] = back[begin[:m] + t, label[:m]]
    return labels


def decode(field: Field, scores: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Labels of all tokens; ``ends`` marks the last token of each document.

    A token whose score for ``other`` exceeds every other label's by more than
    the two moves beside it can make up for is ``other`` in the best labelling, so
    only runs between such tokens need the recursion.
    """
    gain = (field.move - field.move[:, :1]).max(0) + (field.move - field.move[:1, :]).max(1)
    loud = (scores[:, 1:] + gain[1:] >= scores[:, :1]).any(1)
    labels = np.zeros(len(scores), np.int8)
    at = np.flatnonzero(loud)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | ends[at[:-1]]
        labels[at] = viterbi(scores[at], np.diff(np.append(np.flatnonzero(new), len(at))), field.move)
    return labels


def _places(text: str, tokens: list[str], wanted: np.ndarray) -> dict[int, int]:
    """Start of each wanted token, by one walk over the text."""
    found, at, want = {}, 0, set(wanted.tolist())
    for i, token in enumerate(tokens):
        at = text.index(token, at)
        if i in want:
            found[i] = at
        at += len(token)
    return found


class Finder:
    """Spans of a batch of texts: the base spans, then those the field adds."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, tuple[int, int]] = {}

    def codes(self, token: str) -> tuple[int, int]:
        if token not in self.known:
            if len(self.known) >= 200_000:
                self.known.clear()
            self.known[token] = self.field.codes(token)
        return self.known[token]

    def __call__(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        split = [t.split() for t in texts]
        lengths = np.fromiter(map(len, split), int, len(split))
        stops = np.cumsum(lengths)
        added: list[list[Span]] = [[] for _ in texts]
        if stops[-1] if len(stops) else 0:
            codes = np.array([self.codes(t) for tokens in split for t in tokens])
            last = np.zeros(len(codes), bool)
            last[stops[lengths > 0] - 1] = True
            first = np.roll(last, 1)
            labels = decode(self.field, self.field.scores(codes[:, 0], codes[:, 1], first, last), last)
            hits = np.flatnonzero(labels)
            for d in np.unique(np.searchsorted(stops, hits, side="right")).tolist():
                own = labels[stops[d] - lengths[d]:stops[d]]
                added[d] = self._spans(texts[d], split[d], own)
        out = []
        for text, more in zip(texts, added):
            base = base_spans(text)
            out.append((sorted(base), sorted(base + [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)])))
        return out

    @staticmethod
    def _spans(text: str, tokens: list[str], labels: np.ndarray) -> list[Span]:
        at = np.flatnonzero(labels)
        place = _places(text, tokens, at)
        spans, i = [], 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] == at[j] + 1 and labels[at[j + 1]] == labels[at[i]]:
                j += 1
            head, tail = tokens[at[i]], tokens[at[j]]
            start = place[at[i]] + len(head) - len(head.lstrip("\"'"))
            stop = place[at[j]] + len(tail.rstrip(_TRAIL))
            if start < stop:
                spans.append((int(labels[at[i]]) - 1, start, stop))
            i = j + 1
        return spans


SPANS = "array<struct<kind:int,start:bigint,stop:bigint>>"


def find(df: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, base, found) for every row: spans by kind, then start.

    ``found`` holds the base spans and those the field adds; an added span that
    overlaps a base span is left to it.  A NULL or empty text has no spans; rows
    without a key and repeated rows are searched like any other; other columns
    are not read.  Work is by row: no shuffle.
    """
    field = field or train(labelled_table())

    def start():
        finder = Finder(field)
        return lambda columns: [(name, *spans) for name, spans in zip(columns[0], finder([t or "" for t in columns[1]]))]

    return map_rows(df, {"doc_id": F.col(key), "text": F.col(text)}, f"doc_id bigint, base {SPANS}, found {SPANS}", start)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in capitals; spans that overlap are replaced as one."""
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """The rows with the personal data in ``text`` replaced; all columns stay, a NULL text stays NULL."""
    field = field or train(labelled_table())
    place = df.columns.index(text)

    def start():
        finder = Finder(field)

        def work(columns: list[list]) -> Iterable[tuple]:
            texts = columns[place]
            spans = finder([t or "" for t in texts])
            columns[place] = [t and redact(t, s[1]) for t, s in zip(texts, spans)]
            return zip(*columns)

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_rows(df, {c: F.col(f"`{c}`") for c in df.columns}, schema, start)


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
