import random
import re

import numpy as np
import pytest

from cohortloom.llm import ngram_join, registered


def grams(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets = [grams(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    out = []
    for i, (key, _) in enumerate(docs):
        keys = [docs[j][0] for j in range(len(docs)) if group[j] == group[i] and docs[j][0] is not None]
        out.append((key, len(sets[i]), min(keys, default=None)))
    return out


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 400)) for _ in range(n)]


def planted(rng):
    passage = words(rng, 60)
    texts = [None, "", " \t", "one", "One", "a b", "A\tB", "a b c d e", "a b c d e f"]
    for family in range(14):
        base = words(rng, rng.choice([8, 20, 40, 90, 200]))
        for _ in range(rng.randint(2, 9)):  # chains: each from the one before
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(base))
                base[at:at + rng.choice([0, 1])] = words(rng, 1)
    for n in (2, 5, 14, 20, 40, 200):  # one passage in texts of all sizes
        texts += [" ".join(words(rng, n) + passage) for _ in range(6)]
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs + [(None, texts[20]), (None, "all alone here"), docs[5], docs[5]]


@pytest.mark.parametrize("seed, frequent", [(1, 256), (2, 4), (3, 2)])
def test_components_equal_brute_force(rows, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = planted(random.Random(seed))
    found = ngram_join.join(rows(*docs)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute(docs), key=key)
    firsts = [r for r in found if r.first]
    assert len(firsts) == len({r.component_id for r in found if r.component_id is not None}) + sum(r.component_id is None for r in found)


def test_shingles_and_prefixes():
    rng = random.Random(9)
    shingler = ngram_join.Shingler()
    for _ in range(200):
        text = "".join(rng.choice("aB c\n\té") for _ in range(rng.randint(0, 80)))
        assert len(shingler(text)) == len(grams(text))
    assert len(shingler(" ".join(words(rng, 30_000)))) == 29_996
    for n in range(1, 60):  # so many members of any common part of the least size lie in the prefix
        assert ngram_join.prefix_length(n) == min(n, n - int(np.ceil(0.75 * n)) + 2 + n // 16)
    values = np.sort(np.random.default_rng(0).integers(0, 2 ** 63, 1000).astype(np.uint64))
    assert np.array_equal(ngram_join._unpack(ngram_join._pack(values)), values)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    found = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_no_rows_and_no_links(rows):
    assert ngram_join.join(rows((1, "x")).limit(0)).count() == 0
    assert {(r.doc_id, r.component_id) for r in ngram_join.join(rows((2, "a b c"), (1, "d e f"), (3, None))).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_query_equals_its_sql(spark, duck, folder):
    df = registered.op4_ngram_join(spark, folder)
    want = duck.execute(f"SELECT {','.join(df.columns)} FROM ({ngram_join.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_each_candidate_pair_comes_out_once(spark, monkeypatch):
    """Lists cut into many blocks: every pair with enough shared members, at its smallest shared one, and no other."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
    rng = random.Random(4)
    sets = {node: (rng.randint(8, 14), rng.randrange(3), sorted(rng.sample(range(25), rng.randint(2, 9)))) for node in range(60)}
    small = spark.createDataFrame([(node, *s) for node, s in sets.items()], "node bigint, n bigint, label bigint, m array<bigint>")
    found = [(r.a, r.b) for r in ngram_join._subset_pairs(small).collect()]
    least = lambda x, y: int(ngram_join._least_shared(np.array(x), np.array(y)))
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1]
            and min(sets[a][0], sets[b][0]) * 100 >= 75 * max(sets[a][0], sets[b][0])
            and len(set(sets[a][2]) & set(sets[b][2])) >= least(sets[a][0], sets[b][0])}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20


def test_sets_of_one_home_meet_once_and_not_in_every_list(spark, monkeypatch):
    """op4, pipeline: near copies that share many long lists are copied to the blocks of one of them."""
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 8)
    rng = random.Random(8)
    sets = {node: (12, node, sorted([0] + rng.sample(range(1, 12), 9))) for node in range(64)}  # all in list 0
    sets |= {100: (12, 100, list(range(1, 11)))}
    small = spark.createDataFrame([(node, *s) for node, s in sets.items()], "node bigint, n bigint, label bigint, m array<bigint>")
    moved = ngram_join._blocked(small)
    members = sum(len(s[2]) for s in sets.values())
    assert moved.count() < 64 * 8 + 2 * members  # 10 lists of about 50 sets, each set to 7 blocks in each, before
    least = int(ngram_join._least_shared(np.array(12), np.array(12)))
    found = [(r.a, r.b) for r in ngram_join._subset_pairs(small).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a][2]) & set(sets[b][2])) >= least}
    assert len(found) == len(set(found)) and set(found) == want and any(b == 100 for _, b in want)


def test_sizes_needed_in_columns_and_arrays_agree(spark):
    a, b = np.meshgrid(np.arange(1, 90), np.arange(1, 90))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a.ravel(), b.ravel())], "a bigint, b bigint")
    assert [r.k for r in df.select(ngram_join._least("a", "b").alias("k")).collect()] == ngram_join._least_shared(a, b).ravel().tolist()


def test_many_near_threshold_sets_without_keys(rows):
    """Copies of one text, all with NULL keys, changed so that some pairs link and most do not."""
    rng = random.Random(6)
    base = words(rng, 40)
    docs = [(None, " ".join(base)), (1, " ".join(base[:-1]))]
    for _ in range(400):
        text = list(base)
        for at in rng.sample(range(40), 2):
            text[at] = f"z{rng.randint(0, 10 ** 6)}"
        docs.append((None, " ".join(text)))
    found = ngram_join.join(rows(*docs)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute(docs), key=key)


def test_deduplicated_keeps_wordless_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "", "x"), (None, None, "y"), (None, " ", "z"), (3, "a b c", "x"), (2, "a b c", "y"), (2, "a b c", "y")],
                               "doc_id bigint, text string, _mark string")
    df = df.withColumn("key", df["_mark"]).withColumn("mark", df["_mark"]).withColumn("_key", df["_mark"])
    out = ngram_join.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r["_mark"]) for r in out.collect()) == [(0, "x"), (0, "y"), (0, "z"), (2, "y")]
