import hashlib
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import conversation_trie as ct
from cohortloom.llm import registered

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    """Nodes by their tuple of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    made = own
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        made = {c: own.get(int(c / 20) * 20, [])[:h[c]] + own[c][h[c]:] for c in own}
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        kids = [n for n in members if len(n) == len(node) + 1 and n[:len(node)] == node]
        below = [n for n in members if n[:len(node)] == node]
        saved = sum((len(members[n]) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", n[-1][1])) if n else 0) for n in below)
        leaves = sum(not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below) for n in below)
        ends = ",".join(map(str, sorted(c for c in ids if len(made[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), min_size=1, max_size=30), st.integers(1, 7))
def test_the_trie_has_every_prefix_once(sequences, size):
    trie, paths = ct.ZFastTrie(), []
    for name, symbols in enumerate(sequences):
        path, at = [], ct.ROOT
        for s in symbols:
            at = hashlib.md5(at + bytes([s])).digest()
            path.append(at)
        paths.append((path, symbols, name))
    for i in range(0, len(paths), size):
        trie.insert_batch(paths[i:i + size])
    want = defaultdict(list)
    for path, _, name in paths:
        for i in range(len(path) + 1):
            want[path[i - 1] if i else ct.ROOT].append((name, i))
    got = {p: (m, s, d) for p, _, d, m, s, _ in trie.expanded()}
    assert got == {p: (len(v), min(v)[0], v[0][1]) for p, v in want.items()}
    for path, _, _ in paths:  # fat binary search ends where a walk from the root does
        node, at = 0, 0
        while at < len(path) and (down := trie.child.get(path[at])) is not None and trie.depth[down] <= len(path) \
                and trie.edge[down][-1] == path[trie.depth[down] - 1]:
            node, at = down, trie.depth[down]
        assert trie.exit_parent(path) == node


def test_a_two_fattest_number_is_divided_by_the_highest_power():
    for low in range(40):
        for high in range(low + 1, 41):
            assert ct.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda i: i & -i)


def rows_of(spark, rows):
    from pyspark.sql import functions as F
    return (spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
            .withColumn("path", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("prefix", F.lit(None).cast("int")))


def test_nulls_ties_repeats_and_absent_bases(spark):
    rows = [(0, 1, "user", "a b"), (0, 0, None, None), (0, None, "user", "first"), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "bot", "x"),
            (21, 0, "user", "hello there"), (22, 0, "user", "hello there"), (22, 1, "bot", " \t"), (None, 0, "user", "lost"),
            (45, 0, "", "é ü"), (46, 0, None, "é ü"), (-3, 5, "user", "neg"), (-20, 0, "user", "neg base"), (3, 0, "user", "y " * 5000)]
    df = rows_of(spark, rows)
    assert found(ct.build(ct.rebuilt(df))) == brute(rows)
    assert found(ct.build(ct.conversations(df))) == brute(rows, rebuild=False)
    assert ct.build(ct.rebuilt(df.limit(0))).count() == 0


def test_tries_of_many_tasks_and_small_tries_add_up(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, "user", rng.choice("abc")) for c in range(400) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "bot", "same") for c in range(400, 800) for t in range(3)]
    want = brute(rows)
    assert found(ct.build(ct.rebuilt(rows_of(spark, rows)))) == want
    monkeypatch.setattr(ct, "MAX_HELD", 50)
    monkeypatch.setattr(ct, "HEAVY", 3)
    assert found(ct.build(ct.rebuilt(rows_of(spark, rows)))) == want


def test_query_equals_its_sql_and_brute_force(spark, folder, duck):
    got = found(registered.op11_conversation_trie(spark, folder))
    cursor = duck.execute(ct.SQL)
    at = [[d[0] for d in cursor.description].index(c) for c in COLUMNS]
    assert got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
