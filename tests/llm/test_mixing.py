import math
from collections import Counter, defaultdict

import pytest

from cohortloom.llm import mixing, registered


def docs(sizes):
    out, n = [], 0
    for source, (count, words) in sizes.items():
        for _ in range(count):
            out.append((n, " ".join(["w"] * words), source))
            n += 1
    return out


def test_repetition_limit_and_budgets(rows):
    df = rows(*docs({"a": (300, 10), "b": (40, 7), "c": (5, 12)}))
    found = mixing.mix(df, max_repeats=3.0).collect()
    total = {"a": 3000, "b": 280, "c": 60}
    got = defaultdict(int)
    for r in found:
        got[r.source] += r.tokens
    a = 1 - math.log(3) / math.log(3000 / 60)
    for source, t in total.items():
        budget = t * (t / 3000) ** (a - 1)
        assert budget - 1 <= got[source] < budget + 12
    passes = Counter((r.source, r.epoch, r.doc_id) for r in found)
    assert set(passes.values()) == {1} and {r.doc_id for r in found} == set(range(345))
    for source in total:  # starts are the running sums of a permutation in every pass
        own = sorted((r.start_token, r.tokens) for r in found if r.source == source)
        assert all(s + t == nxt for (s, t), (nxt, _) in zip(own, own[1:])) and own[0][0] == 0
    orders = [[r.doc_id for r in sorted(found, key=lambda r: r.start_token) if r.source == "c" and r.epoch == e] for e in (1, 2)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]


@pytest.mark.parametrize("share", [0.7, 0.95])
def test_target_entropy_is_met(rows, share):
    totals = {"a": 3000, "b": 280, "c": 60}
    target = share * math.log(3)
    measured = mixing.measured(rows(*docs({"a": (300, 10), "b": (40, 7), "c": (5, 12)})))
    a = mixing.bisect_exponent(mixing.source_totals(measured), None, target)
    w = [t ** a for t in totals.values()]
    p = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in p) - target) < 1e-6


def test_a_given_budget_can_cut_sources(rows):
    found = mixing.mix(rows(*docs({"a": (300, 10), "b": (40, 7)})), max_repeats=2.0, budget=1000).collect()
    assert 1000 - 2 <= sum(r.tokens for r in found) < 1000 + 20


def test_many_blocks_give_the_same_schedule(rows, monkeypatch):
    df = rows(*docs({"a": (300, 10), "b": (40, 7)}))
    one = sorted(map(tuple, mixing.mix(df, max_repeats=1.5).collect()))
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    assert sorted(map(tuple, mixing.mix(df, max_repeats=1.5).collect())) == one


def test_odd_rows_and_the_rows_themselves(rows):
    df = rows((1, "a b", None), (2, None, "x"), (3, "", "x"), (None, "a b c", "x"), (4, "a b", "y"), (4, "a b", "y"), (5, "é " * 50, "y"))
    found = mixing.mix(df)
    uses = Counter(r.doc_id for r in found.collect())
    assert set(uses) == {1, 2, 3, None, 4, 5}
    again = mixing.mixed(df)
    assert again.columns == df.columns and Counter(r.doc_id for r in again.collect()) == uses
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    assert {r.doc_id for r in mixing.mix(rows((7, "", "z"))).collect()} == {7}


def test_query_equals_its_sql_without_python(spark, duck, folder):
    df = registered.op3_mixing(spark, folder)
    assert "Python" not in (plan := df._jdf.queryExecution().toString()) and "Arrow" not in plan
    want = duck.execute(f"SELECT {','.join(df.columns)} FROM ({mixing.SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_mixed_leaves_clashing_columns_alone(spark):
    names = ["_source", "_from", "_passes", "_cut", "_copy", "given", "passes", "cut", "origin", "copy"]
    df = spark.createDataFrame([(i, "a b c", "ab"[i % 4 == 0]) for i in range(40)], "doc_id bigint, text string, source string")
    wide = df.select("*", *[df["doc_id"].alias(n) for n in names])
    out = mixing.mixed(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert all(r[n] == r["doc_id"] for r in rows for n in names)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in mixing.mixed(df).collect())
