"""Tokenizer results remembered by text segment.

``Segments`` cuts at single spaces between two visible Latin characters.  A
tokenizer whose pre-tokens or word marks start at such a space encodes the
segments as it would encode the whole text, so a segment is encoded once.
``Words`` is for tokenizers that drop white space and never join over it: it
cuts at every space and line end and works on whole columns.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Segments a task remembers before it starts over, and the longest one it keeps; they change the speed only.
REMEMBERED, KEPT_LENGTH = 200_000, 48
#: Segments encoded in one call, which bounds the tokenizer's own objects.
TOGETHER = 4096
CUT = re.compile("(?<=[!-~¡-ɏ]) (?=[!-~¡-ɏ])")


def _encoded(new: list[str], encode_many: Callable[[list[str]], list]) -> Iterator[tuple]:
    return ((s, v) for i in range(0, len(new), TOGETHER) for s, v in zip(new[i:i + TOGETHER], encode_many(new[i:i + TOGETHER])))


class Segments:
    """Values of the segments of texts; ``encode_many`` makes those of new segments together."""

    def __init__(self, encode_many: Callable[[list[str]], list]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.encode_many, self.known = encode_many, {}

    def of(self, texts: list[str]) -> list[list]:
        known, parts = self.known, [CUT.split(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*parts).difference(known))
        known.update(_encoded(new, self.encode_many))
        values = [list(map(known.__getitem__, p)) for p in parts]
        for s in new:
            if len(s) > KEPT_LENGTH:
                del known[s]
        return values


class Words:
    """Ids of a column of texts from the ids of their words, for a lower-casing tokenizer that marks the ends of words.

    Plain Latin words, in lower case, are encoded many to a call and told apart by
    the entries that carry the end mark; anything else is encoded by itself.
    Before the cut, ASCII letters become lower case and a mark after a letter or
    digit gets a space before it: the tokenizer does both, so its ids stay, and fewer
    words differ.  Texts with combining marks (composed before letters are lowered)
    or a special entry are cut as they are.
    """

    REMEMBERED, JOINED = 500_000, 512
    LETTERS, MARKS = frozenset(string.ascii_letters), frozenset(",.;:!?")
    PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
    MARKED = "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:;=?@\\\\\\]^_`}~])"  # ASCII marks but the apostrophe, which may begin a word

    def __init__(self, coder):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        suffix = json.loads(coder.to_str())["model"]["end_of_word_suffix"]
        vocabulary = coder.get_vocab()
        self.coder, self.known, self.last = coder, {}, np.zeros(max(vocabulary.values()) + 1, bool)
        self.special = [a.content for a in coder.get_added_tokens_decoder().values()]
        self.last[[i for entry, i in vocabulary.items() if entry.endswith(suffix)]] = True

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's start."""
        parts = pc.split_pattern(pc.replace_substring(self._loosened(pc.fill_null(texts, "")), "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        place, values = coded.indices.to_numpy(), self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat, first, each = np.frombuffer(b"".join(values), np.uint32), np.cumsum(sizes) - sizes, sizes[place]
        ends = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(first[place] - ends[:-1], each) + np.arange(ends[-1])], ends[parts.offsets.to_numpy()]

    def _loosened(self, texts: pa.Array) -> pa.Array:
        left = pc.match_substring_regex(texts, "\\pM")
        for entry in self.special:
            left = pc.or_(left, pc.match_substring(texts, entry, ignore_case=True))
        return pc.if_else(left, texts, pc.replace_substring_regex(pc.ascii_lower(texts), self.MARKED, "\\1 \\2"))

    def _values(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        new = [w for w in words if w not in known]
        cut = [w for w in new if w[-1:] in self.MARKS and w[-2:-1] in self.LETTERS]  # the mark is a word of its own to the tokenizer
        whole = {*new}.difference(cut).union([w[:-1] for w in cut], [w[-1] for w in cut]).difference(known)
        plain = [w for w in whole if w.isalpha() and (w.isascii() or self.PLAIN(w))]
        low = [w.lower() for w in plain]
        known.update(self._joined([*set(low).difference(known)]))
        known.update(zip(plain, map(known.__getitem__, low)))
        known.update(_encoded([*whole.difference(plain)], self._each))
        known.update([(w, known[w[:-1]] + known[w[-1]]) for w in cut])
        values = list(map(known.__getitem__, words))
        for w in {w for part in (new, whole, low) for w in part if len(w) > KEPT_LENGTH}:
            known.pop(w, None)
        return values

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.coder.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> Iterator[tuple]:
        for part in (words[i:i + self.JOINED] for i in range(0, len(words), self.JOINED)):
            ids = np.array(self.coder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            yield from zip(part, (ids[i:j].tobytes() for i, j in zip(at, at[1:])))


def sliced(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``size`` bytes in a column together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    return (batch.slice(i, j - i) for i, j in zip(edges, edges[1:]) if j > i)
