import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.llm import registered, suffix_dedup

L = suffix_dedup.LENGTH


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40) | st.lists(st.integers(1, 60), max_size=40))
def test_suffix_array_equals_sorting(symbols):
    text = [*symbols, 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("unit", [[1], [1, 2], [2, 1, 1], [3, 1, 2, 1]])
def test_suffix_array_of_periodic_texts(unit):
    text = [*(unit * 60), 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def brute(docs):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i:i + L] for r in raws for i in range(len(r) - L + 1))
    out = []
    for (key, _), raw in zip(docs, raws):
        gone = [False] * len(raw)
        for i in range(len(raw) - L + 1):
            if seen[raw[i:i + L]] > 1:
                gone[i:i + L] = [True] * L
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def planted(rng):
    def prose(n):
        return "".join(rng.choice("abcdefgh é,") for _ in range(n))

    shared = [prose(n) for n in (370, 388, 392, 400, 410, 470, 900)]
    texts = [None, "", "short", prose(399), "In " * 400, "xy" * 300 + prose(500) + "xy" * 300, shared[-1], shared[-1]]
    for s in shared:
        texts += [prose(rng.randint(0, 300)) + s + prose(rng.randint(0, 300)) for _ in range(4)]
    base = prose(2500)
    for _ in range(10):  # near copies: edits at changing distances
        x = list(base)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x))] = rng.choice("XYZ")
        texts.append("".join(x))
    for cut in range(12):  # ends that differ by a byte
        texts.append(base[100 + cut:560 + 2 * cut] + prose(40))
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, shared[4]), (None, prose(800)), (3, prose(500))]
    rng.shuffle(docs)
    return docs + [docs[0], docs[1]]


def result(df):
    return [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), r.sha) for r in
            df.select("*", F.sha2("kept", 256).alias("sha")).collect()]


@pytest.mark.parametrize("seed, limit", [(1, 20_000), (2, 20_000), (3, 2)])
def test_removed_bytes_equal_brute_force(rows, monkeypatch, seed, limit):
    monkeypatch.setattr(suffix_dedup, "CLASS_LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "UNITS_A_CALL", 500)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 700)
    docs = planted(random.Random(seed))
    key = lambda r: tuple((x is None, x or 0) for x in r[:4]) + r[4:]
    assert sorted(result(suffix_dedup.remove(rows(*docs))), key=key) == sorted(brute(docs), key=key)


def test_passages_of_over_50_words_go_by_their_bytes(rows):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    passages = [words(n) for n in range(51, 121)]
    docs = [(2 * i + j, words(40) + a + p + z + words(40)) for i, p in enumerate(passages) for j, (a, z) in enumerate(("<>", "[]"))]
    lost = {key: removed for key, _, removed, _, _ in result(suffix_dedup.remove(rows(*docs)))}
    assert 0 < sum(len(p) < L for p in passages) < len(passages)
    assert lost == {key: len(passages[key // 2]) * (len(passages[key // 2]) >= L) for key, _ in docs}


@pytest.mark.parametrize("heavy", [1, 1_000_000])
def test_keys_joined_by_hash_or_broadcast_alone(rows, monkeypatch, heavy):
    monkeypatch.setattr(suffix_dedup, "HEAVY", heavy)
    monkeypatch.setattr(suffix_dedup, "CLASS_LIMIT", 2)
    docs = planted(random.Random(4))
    key = lambda r: tuple((x is None, x or 0) for x in r[:4]) + r[4:]
    assert sorted(result(suffix_dedup.remove(rows(*docs))), key=key) == sorted(brute(docs), key=key)


def test_rows_of_a_frequent_key_do_not_meet_in_one_task(spark):
    table = spark.range(4000).repartition(4).select("id", F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id")).alias("anchor"))
    groups = table.groupBy("anchor").agg(F.count("*").alias("n"))
    found = suffix_dedup._among(table, groups, ["anchor"])
    assert sorted(r.id for r in found.collect()) == list(range(4000))
    tasks = found.filter("anchor = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 400


def test_no_rows(rows):
    assert suffix_dedup.remove(rows((1, "x")).limit(0)).count() == 0


def test_query_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in registered.documents(spark, folder, "doc_id", "text").collect()]
    found = registered.op7_suffix_dedup(spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted(brute(docs))
