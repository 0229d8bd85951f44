import itertools
import random
import re

import numpy as np
import pytest

from cohortloom.llm import registered, toxicity

WORDS = "the idiot and a moron went with some other people over there to read their letters in silence".split()


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(0)
    texts = [(" ".join(rng.choice(WORDS) for _ in range(200)),) for _ in range(20)]
    return toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([*texts, (None,), ("",)], "text string")))


def test_trigram_counts_equal_brute_force(spark):
    texts = ["Ab c1Éa", "", None, "zz"]
    want = np.zeros(toxicity.LETTERS ** 3)
    for text in filter(None, texts):  # texts are set apart by two edges
        code = [0, 0] + [ord(c) - 96 if "a" <= c <= "z" else 27 if c == "é" else 0 for c in text.lower().replace("é", "éé")] + [0, 0]
        for a, b, c in zip(code, code[1:], code[2:]):
            want[(a * 28 + b) * 28 + c] += 1
    got = toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    got[0] = want[0] = 0  # edges beside edges
    assert np.array_equal(got, want)


def test_viterbi_equals_search_over_all_readings(model):
    table, rng = model.tolist(), random.Random(4)

    def brute(token):
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", token)]
        ways = []
        for char, n in runs:
            if char.isalpha():
                ways.append([(char * n, 0.0)] if n < 3 else [(char, -0.5), (char * 2, -0.5)])
            else:
                letters = toxicity.LOOKALIKES[char]
                full = [("".join(w), -1.0 * min(n, 2)) for w in itertools.product(letters, repeat=min(n, 2))]
                same = full if n == 2 else [(w, s) for w, s in full if len(set(w)) == 1]
                ways.append(same + ([(x, -1.0) for x in letters] if n > 1 else []) + [("", -6.0)])
        best = None
        for way in itertools.product(*ways):
            word, score, p, q = "".join(w for w, _ in way), sum(s for _, s in way), 0, 0
            for x in word + "\0":
                c = 0 if x == "\0" else toxicity._code(x)
                score += table[p][q][c]
                p, q = q, c
            best = max(best or (-1e9, ""), (score, word))
        return best

    for _ in range(200):
        token = "".join(rng.choice("aeidotm01!3$") for _ in range(rng.randint(1, 7)))
        assert toxicity.restore(token, table) == brute(token)[1]


@pytest.mark.parametrize("seen, word", [("1d10t", "idiot"), ("idiooooot", "idiot"), ("m0r0n!", "moron"), ("Moron,", "moron"), ("p30ple", "people"), ("1234", ""), ("", "")])
def test_tokens_are_restored(model, seen, word):
    assert toxicity.word_of(seen, model.tolist()) == word


def test_letters_set_apart_are_drawn_together():
    assert toxicity.spaced_words("an i d i o t and m.o.r.o.n, 1.2.3.4, a b") [::4] == ["idiot", "moron"]


def test_obfuscated_toxic_documents_are_caught_and_clean_ones_left(spark, rows):
    rng = random.Random(1)
    plain = [w for w in WORDS if w not in ("idiot", "moron")]
    text = lambda *more: " ".join(rng.sample([rng.choice(plain) for _ in range(40)] + list(more), 40 + len(more)))
    docs = [(i, text("idiot", "moron") if i % 3 == 0 else text()) for i in range(300)]
    docs += [(1000, text("1d10t")), (1001, text("m o r o n")), (1002, text("idiooooot")), (1003, text()), (1004, ""), (1005, None),
             (None, text("idiot")), (1003, text())]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None), (7777, 1)], "doc_id bigint, toxic int")
    df = rows(*docs)
    fitted = toxicity.fit(df, labels)
    found = toxicity.score(df, fitted).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    hit = {r.doc_id for r in found if r.score >= toxicity.THRESHOLD}
    assert hit == {i for i in range(300) if i % 3 == 0} | {1000, 1001, 1002, None}
    kept = toxicity.kept(df, fitted)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found} - hit
    empty = toxicity.fit(df.limit(0), labels.limit(0))
    assert toxicity.score(df.limit(0), empty).count() == 0
    assert {r.score >= 0.5 for r in toxicity.score(df, empty).collect()} == {False}


def test_words_of_few_labelled_documents_are_learned(spark, rows):
    rng = random.Random(2)
    plain = ["".join(rng.choice("aeinorst") for _ in range(7)) for _ in range(400)]
    text = lambda *more: " ".join(rng.sample(plain, 40) + list(more))
    toxic = {i for i in range(60) if i % 10 == 1}
    df = rows(*[(i, text("idiot", "moron") if i in toxic else text()) for i in range(60)], (1000, text("idiot", "m0r0n")), (1001, text()))
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(60)], "doc_id bigint, toxic int")
    found = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert {r.doc_id for r in found if r.score >= toxicity.THRESHOLD} == toxic | {1000}


def test_only_near_copies_are_merged(spark):
    rng = random.Random(3)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage, copied = fresh(30), fresh(60)
    texts = [(" ".join(passage + fresh(30)), i % 2) for i in range(40)]
    texts += [(" ".join(copied[:i] + ["changed"] + copied[i + 1:]), 1) for i in range(0, 8)] + [(" ".join(copied), 0)] * 3
    left = toxicity.without_copies(spark.createDataFrame(texts, "text string, label int")).collect()
    assert {t for t, _ in texts[:40]} <= {r.text for r in left} and len(left) == 41


def test_the_cut_has_the_fewest_errors_and_is_near_even_odds():
    assert toxicity.best_cut([(-2.0, 0), (-1.0, 0), (2.0, 1)], -2.0) == 0.0
    assert toxicity.best_cut([(-2.0, 0), (1.0, 0), (3.0, 1), (-2.0, 1)], -2.0) == 1.5
    assert toxicity.best_cut([(-2.0, 0)] * 9 + [(-2.0, 1)], -2.0) > -2.0


def test_query_has_one_row_per_document(spark, folder):
    df = registered.op8_toxicity(spark, folder)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 200
