import hashlib
import random

import numpy as np
import pytest

from cohortloom.llm import order_minhash as om
from cohortloom.llm import registered


def plain_signature(text):
    """The same by definition, one hash function and one k-mer at a time."""
    h = om.kmers(text)
    out, seen, numbered = [], {}, []
    for x in h.tolist():
        seen[x] = seen.get(x, -1) + 1
        numbered.append(int(om._stir(np.array([x], np.uint64) + np.array([seen[x]], np.uint64) * om._MIX)[0] >> np.uint64(32)))
    for f in om._FACTORS.tolist():
        chosen = sorted(sorted(range(len(h)), key=lambda i: (numbered[i] * f % 2 ** 32, i))[:om.TUPLE])
        value = np.array([len(chosen)], np.uint64)
        for i in chosen:
            value = om._stir(value * om._BASE + h[i:i + 1])
        out.append(int(value[0] >> np.uint64(32)))
    return out if len(h) else [0] * om.SKETCHES


@pytest.mark.parametrize("text", ["", "a", "short text", "exactly 12ch", "ab" * 40, "é😀x" * 30, "the quick brown fox jumps over the lazy dog " * 3])
def test_signature_equals_its_definition(text):
    assert om.signature(text).tolist() == plain_signature(text)


def test_kmers_are_those_of_the_text():
    text = "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop"
    h = om.kmers(text)
    assert len(h) == len(text) - om.K + 1
    same = {}
    for i in range(len(h)):
        same.setdefault(text[i:i + om.K], set()).add(int(h[i]))
    assert all(len(v) == 1 for v in same.values()) and len(set(h.tolist())) == len(same)


def test_likeness_falls_with_edits_and_feels_order():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    few = " ".join("xxxxxx" if i % 100 == 7 else w for i, w in enumerate(words))
    many = " ".join("xxxxxx" if i % 8 == 3 else w for i, w in enumerate(words))
    swapped = " ".join(words[200:] + words[:200])
    sig = om.signature
    a, b, c, d = (om.likeness(sig(text), sig(t)) for t in (text, few, many, swapped))
    assert a == 1.0 and b > 0.6 > c and b > c and d < 0.8
    assert om.likeness(sig(text), sig(" ".join(words[::-1]))) < 0.3
    assert len(om.signature("x" * 3_000_000)) == om.SKETCHES


def check(found, docs):
    order = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(found) == len(docs)
    by = {r.doc_id: r for r in found}
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", by[key]
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == om.as_text(om.signature(text)) and r.edited_fingerprint == om.as_text(om.signature(changed))
        assert r.near_edited == om.likeness(om.signature(text), om.signature(changed))
        assert r.near_next == om.likeness(om.signature(text), om.signature(following))


def test_each_row_meets_the_next_in_descending_order(rows):
    rng = random.Random(3)
    docs = [(i * 7 - 100, "".join(rng.choice("ab cdé") for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(5000, None), (None, "no key"), (-9000, "")]
    check(om.against_next(rows(*docs)).collect(), docs)


def test_small_tables_and_repeated_rows(rows):
    assert om.against_next(rows((1, "x")).limit(0)).count() == 0
    one = om.against_next(rows((1, "hello there, whole text"))).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    twice = om.against_next(rows((1, "abc abc abc abc abc"), (1, "abc abc abc abc abc"), (1, "other"))).collect()
    assert len(twice) == 3 and om.fingerprint(rows((1, None), (1, ""))).select("fingerprint").distinct().count() == 1


def test_query_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in registered.documents(spark, folder, "doc_id", "text").collect()]
    check(registered.op1_order_minhash(spark, folder).collect(), docs)
