import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortloom.llm import packing, registered, segments

FILE = public_tokenizers.path("word_bpe_49k.json")
CODER = Tokenizer.from_file(FILE)


def best_fit(lengths, capacity):
    """Loads of the bins when every piece is placed on its own."""
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        insort(rooms, room - length)
    return Counter(capacity - r for r in rooms)


def placed(lengths, capacity):
    rows, taken, out = packing.plan(Counter(lengths), capacity), Counter(), []
    for length in lengths:
        rank, (_, first, sequence, offset, each) = taken[length], max(r for r in rows if r[0] == length and r[1] <= taken[length])
        taken[length] += 1
        out.append((sequence + (rank - first) // each, offset + (rank - first) % each * length, length))
    return out


def sound(rows, capacity):
    """Each sequence is filled from 0 without gaps, up to the capacity; returns the loads."""
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    loads = Counter()
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        loads[at] += 1
    return loads


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_the_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    assert sound(placed(lengths, capacity), capacity) == best_fit(lengths, capacity)


def test_the_tree_finds_the_tightest_room():
    rng, rooms, used = random.Random(1), packing.Rooms(37), set()
    for _ in range(3000):
        room, on = rng.randint(0, 37), rng.random() < 0.3
        rooms.set(room, on)
        (used.add if on else used.discard)(room)
        need = rng.randint(0, 37)
        assert rooms.tightest(need) == min((r for r in used if r >= need), default=-1)


def test_the_plan_stays_small_whatever_the_counts():
    rng = random.Random(2)
    rows = packing.plan({n: rng.randint(1, 10 ** 9) for n in range(1, 4097)})
    assert len(rows) < 40_000


def check(df, docs, capacity):
    rows, want = df.collect(), []
    for name, text in docs:
        ids = [*CODER.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(name, i // capacity, i, len(ids[i:i + capacity]), zlib.crc32(array("I", ids[i:i + capacity]).tobytes())) for i in range(0, len(ids), capacity)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert sound([(r.sequence_id, r.offset, r.length) for r in rows], capacity) == best_fit([w[3] for w in want], capacity)
    return rows


WORDS = segments.Words(CODER)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.none() | st.text(max_size=40) | st.text(alphabet="aBé \n\t.,!'s<|1 \u0301ΣİI\x1c\u2028", max_size=60), max_size=4))
def test_words_are_encoded_as_the_whole_text(texts):
    ids, at = WORDS.of(pa.array(["-", *texts, "-"], pa.string()).slice(1, len(texts)))
    want = [CODER.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want


def test_loosened_words_are_encoded_as_the_whole_text():
    rng = random.Random(3)
    bits = [*"aAzZéÉİıſK'’.,;:!?%&$#*|<>[](){}\"@/\\_-+=~^` \n\t019٣ǄΣσςHJ漢🙂", "\u030c", "\u0331", "\u0307", "J\u030c", "\r\n", "'s", "'LL",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(20_000)]
    ids, at = segments.Words(CODER).of(pa.array(texts))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [e.ids for e in CODER.encode_batch_fast(texts, add_special_tokens=False)]


def test_rows_are_packed_whole(rows):
    texts = [None, "", "  ", "Plain Words, HERE it's  a\n\n test", "<|endoftext|> and <|startoftext|>x", "日本語 😀 ÑANDÚ", "word " * 500, "ab" * 900, "é ﬁ ΑΣ ½", "Σ ΣΑΣ İ"]
    docs = [*enumerate(texts), (None, "no key"), (0, None), (3, texts[3])] + [(100 + i, "same") for i in range(50)]
    for capacity in (7, 16, 4096):
        check(packing.pack(rows(*docs), FILE, capacity), docs, capacity)
    found = packing.pack(rows(*docs), FILE, 16, ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found)
    assert packing.pack(rows((1, "a")).limit(0), FILE).count() == 0


def test_query_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = check(registered.op13_packing(spark, folder), docs, 4096)
    assert rows[0].asDict().keys() >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
