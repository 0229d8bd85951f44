import random
import re

from cohortloom.llm import host_rules, registered


def brute(text):
    words = re.findall("[^ \t-\r]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^ \t-\r]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_counts_equal_brute_force_on_odd_texts(rows):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a a a a", "x\nx\n x\n\n\nx", "a b c a b c d a b c", "é # $$ <b>"]
    texts += ["".join(rng.choice("ab \n　#") for _ in range(120)) for _ in range(30)]
    found = host_rules.measure(rows(*[(i, t, "h") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found} == {
        i: brute(t) for i, t in enumerate(texts)}


def test_a_bad_host_goes_and_a_small_one_is_shrunk(rows):
    good = " ".join(f"w{i}" for i in range(60))
    docs = [(i, "short", "bad") for i in range(40)] + [(100, good, "bad")]
    docs += [(200 + i, good, "good") for i in range(300)] + [(600 + i, "short", "good") for i in range(6)]
    docs += [(700, "short", "tiny"), (701, good, None), (None, good, "good"), (200, good, "good")]
    found = host_rules.judge(rows(*docs))
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert found.count() == len(docs)
    assert not kept[100] and kept[200] and kept[701] and kept[None] and not kept[700]
    rates = {r.host: r.shrunk_rate for r in host_rules.host_rates(
        host_rules.measure(rows(*docs)).withColumn("base_failed", host_rules.base_failed())).collect()}
    assert rates["bad"] > 0.9 > rates["tiny"] > rates["good"] > 6 / 308
    assert host_rules.judge(rows((1, "x", "h")).limit(0)).count() == 0


def test_query_equals_its_sql(spark, duck, folder):
    df = registered.op2_host_rules(spark, folder)
    want = duck.execute(f"SELECT {','.join(df.columns)} FROM ({host_rules.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
