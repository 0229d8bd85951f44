import random

import numpy as np

from cohortloom.llm import quality, registered


def test_votes_equal_a_plain_nearest_neighbour_search():
    rng = np.random.default_rng(0)
    fitted = {"project": rng.normal(size=(quality.TERMS, 6)).astype(np.float32),
              "votes": quality._unit(rng.normal(size=(200, 6)).astype(np.float32)), "labels": rng.integers(0, 2, 200).astype(np.float32)}
    x = rng.random((50, quality.TERMS)).astype(np.float32)
    for row, got in zip(x, quality.votes(x, fitted)):
        v = row @ fitted["project"]
        similar = sorted(((v @ w / np.linalg.norm(v), y) for w, y in zip(fitted["votes"], fitted["labels"])), reverse=True)[:quality.NEIGHBOURS]
        weights = [max(s, 0) ** quality.SHARPNESS for s, _ in similar]
        want = (sum(w * y for w, (_, y) in zip(weights, similar)) + 1e-3 * fitted["labels"].mean()) / (sum(weights) + 1e-3)
        assert abs(got - want) < 1e-4


def test_directions_are_the_leading_singular_vectors():
    x = np.random.default_rng(1).normal(size=(60, 40)) * np.linspace(5, 0.1, 40)
    want = np.linalg.svd(x)[2][:4]
    assert np.allclose(np.abs(want @ quality.directions(x, 4)), np.eye(4), atol=1e-3)


def test_document_frequencies_count_every_text(rows):
    texts = ["abcd", "abc", None, "", "zzz é"]
    n, found = quality.document_frequencies(rows(*enumerate(texts)))
    assert n == 5 and np.array_equal(found, sum((quality.term_counts(t or "") > 0).astype(float) for t in texts))


def test_junk_is_told_from_prose_and_every_row_is_scored(spark, rows):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeinrsth") for _ in range(rng.randint(2, 7)))
    prose = lambda: " ".join(word() for _ in range(80)) + "."
    junk = lambda: " ".join(word().upper() + "!!" for _ in range(80))
    docs = [(i, junk() if i % 5 == 0 else prose()) for i in range(400)] + [(900, junk()), (901, prose()), (902, ""), (903, None), (None, prose()), (901, prose())]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(None, 0), (3, None)], "doc_id bigint, quality int")
    df = rows(*docs)
    found = quality.score(df, quality.fit(df, labels)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.score for r in found}
    assert all((by[i] >= quality.THRESHOLD) == (i % 5 != 0) for i in range(400)) and by[900] < 0.3 and by[901] > 0.9 and by[None] > 0.9
    none = quality.fit(df.limit(0), labels.limit(0))
    assert quality.score(df.limit(0), none).count() == 0 and {round(r.score, 6) for r in quality.score(df, none).collect()} == {0.5}


def test_query_has_one_row_per_document(spark, folder):
    df = registered.op6_quality(spark, folder)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 200
