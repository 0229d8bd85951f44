import itertools
import random
import re

import numpy as np
import pytest

from cohortloom.llm import pii, registered


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def brute(text):
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    for alphabet in ("ab@.", "12.", "1 2-+(", "a1.@+ -é"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert sorted(pii.base_spans(text)) == brute(text), text
    assert pii.base_spans("4539 1488 0343 6467, 999.1.1.1 +1 (784) 555-9263.") == brute("4539 1488 0343 6467, 999.1.1.1 +1 (784) 555-9263.")
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_viterbi_and_the_shortcut_equal_search_over_all_labellings(field):
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5):
        scores = rng.normal(0, 3, (n, len(pii.LABELS)))
        ways = itertools.product(range(len(pii.LABELS)), repeat=n)
        value = lambda w: sum(scores[i, y] for i, y in enumerate(w)) + sum(field.move[a, b] for a, b in zip((0, *w), (*w, 0)))
        best = max(ways, key=value)
        assert tuple(pii.viterbi(scores, np.array([n]), field.move)) == best
    scores = rng.normal(0, 2, (400, len(pii.LABELS)))
    scores[:, 0] += rng.choice([0, 30], 400)
    ends = np.zeros(400, bool)
    ends[[99, 100, 399]] = True
    lengths = np.array([100, 1, 299])
    assert np.array_equal(pii.decode(field, scores, ends), pii.viterbi(scores, lengths, field.move))


def test_the_field_finds_forms_the_patterns_miss_and_leaves_prose_alone(field):
    rng = random.Random(99)
    held = pii.labelled_table(seed=1234, copies=5)
    finder = pii.Finder(field)
    right = total = 0
    for sentence in held:
        text = " ".join(t for t, _ in sentence)
        found = {s[0] for s in finder([text])[0][1]}
        want = {pii.KINDS.index(y) for _, y in sentence if y != "other"}
        total += 1
        right += found == want or (not want and all(s in pii.base_spans(text) for s in finder([text])[0][1]))
    assert right / total > 0.95
    text = "call (988) 555-2485, or 988-555-2485. Mail jane [at] post [dot] com; host 2001:0db8::ff00 now"
    found = [text[a:b] for _, a, b in finder([text])[0][1]]
    assert "(988) 555-2485" in found and "2001:0db8::ff00" in found and any("[at]" in f for f in found)
    prose = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + ". In 2024, 12 of 350 (or 3.4) passed at 10:30."
    assert finder([prose])[0] == ([], [])


def test_every_row_is_returned_and_redacted(rows, field):
    docs = rows((1, None), (2, ""), (None, "a@b.com"), (3, "x a@b.com y +1 (784) 555-9263"), (3, "x a@b.com y +1 (784) 555-9263"))
    found = pii.find(docs, field=field).collect()
    assert len(found) == 5 and [len(r.base) for r in found if r.doc_id == 3] == [2, 2]
    out = pii.redacted(docs, field=field)
    assert out.columns == docs.columns and {r.text for r in out.collect()} == {None, "", "[EMAIL]", "x [EMAIL] y [PHONE]"}
    assert pii.find(docs.limit(0), field=field).count() == 0


def test_query_equals_the_plain_patterns(spark, folder):
    import hashlib
    texts = {r.doc_id: r.text for r in registered.documents(spark, folder, "doc_id", "text").collect()}
    for r in registered.op9_pii(spark, folder).collect():
        base = brute(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in range(4))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
