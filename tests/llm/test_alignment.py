import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortloom.llm import alignment as al
from cohortloom.llm import registered

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PAIR = al.Pair(*(open(f, "rb").read() for f in FILES))
A, B = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
A.encode_special_tokens = True
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def slow_links(a_ends, b_ends):
    spans = [list(zip([0, *e], e)) for e in (a_ends, b_ends)]
    return [(i, j) for i, (s, t) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < t]


def brute(rows):
    """By whole-text encoding and plain overlap of ranges found with two sorted lists."""
    kept = []
    for name, text in rows:
        a, b = A.encode(" " + (text or ""), add_special_tokens=False).ids, B.encode(text or "")
        ab, bb = [PAIR.a_bytes[i] for i in a], [al.piece_bytes(B.id_to_piece(i)) for i in b]
        if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            kept.append((name, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        sa, sb, found = [0, *ea], [0, *eb], []
        for i in range(len(a)):
            low = int(np.searchsorted(eb, sa[i], side="right"))
            while low < len(b) and sb[low] < ea[i]:
                found.append((i, low))
                low += 1
        cuts = sorted(set(ea) & set(eb))
        groups, x, y = [], 0, 0
        for c in cuts:
            p, q = ea.index(c, x) + 1, eb.index(c, y) + 1
            groups.append((a[x:p], b[y:q]))
            x, y = p, q
        kept.append((name, a, b, found, groups))
    counts = Counter((a[i], b[j]) for _, a, b, found, _ in kept for i, j in found)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for name, a, b, found, groups in kept:
        n = [(counts[a[i], b[j]], most[b[j]]) for i, j in found]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((name, len(a), len(b), len(groups), len(found), sum(x == y for x, y in n), sum(x for x, _ in n),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


ends = st.lists(st.integers(1, 4), min_size=1, max_size=12).map(lambda x: np.cumsum(x).tolist())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ends, ends), max_size=6))
def test_lockstep_links_every_overlap_of_every_document(pairs):
    pairs = [(x, y) for x, y in pairs]
    for x, y in pairs:  # both end at the same byte
        last = max(x[-1], y[-1])
        x += [last] if x[-1] < last else []
        y += [last] if y[-1] < last else []
    pairs.insert(len(pairs) // 2, ([], []))
    a_from, b_from = al.starts([len(x) for x, _ in pairs]), al.starts([len(y) for _, y in pairs])
    base = np.concatenate([[0], np.cumsum([x[-1] if x else 0 for x, _ in pairs])])
    a_ends = np.array([e + s for (x, _), s in zip(pairs, base) for e in x], np.int64)
    b_ends = np.array([e + s for (_, y), s in zip(pairs, base) for e in y], np.int64)
    steps, at = al.lockstep(a_ends, b_ends, a_from, b_from), a_from + b_from
    for d, (x, y) in enumerate(pairs):
        own = steps[at[d]:at[d + 1]]
        own = own[own > 0]
        assert list(zip(*(v.tolist() for v in al.links(None, None, own)))) == slow_links(x, y)
        assert (own == 3).sum() == len(set(x) & set(y))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab é\n.'<|1  ñ", max_size=80))
def test_segments_are_encoded_as_the_whole_text(text):
    (a,), (b,) = PAIR.ids([text])
    whole_a, whole_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if len(a):
        assert a.tolist() == whole_a and b.tolist() == whole_b
    else:
        joined = b"".join(PAIR.a_bytes[i] for i in whole_a), b"".join(PAIR.b_bytes[i] for i in whole_b)
        assert not text or joined != ((" " + text).encode(),) * 2


TEXTS = ["plain words here, and more of them", None, "", " ", "  two  spaces ", "<|endoftext|> and <unk> <s> <0x41>", "日本語 😀 ñandú", "a" * 4000, "▁ mark",
         "x\n\ny\tz\r", "plain words here, and more of them", "é ﬁ ½   nbsp", "it's <|endoftext|>", "word " * 3000]


def test_rows_and_light_pairs(rows, monkeypatch):
    data = [*enumerate(TEXTS), (None, "plain words without a key"), (0, None), (0, "plain words here")]
    want = brute(data)
    types = al.id_types(*FILES)
    assert found(al.score(al.align(rows(*data), *FILES), types)) == want
    for top in (0, 40):  # the counts of the other pairs are joined
        monkeypatch.setattr(al, "TOP", top)
        assert found(al.score(al.align(rows(*data), *FILES), types)) == want
    monkeypatch.setattr(al, "SLICE_BYTES", 50)
    monkeypatch.setattr(al, "COUNTED", 50)
    assert found(al.score(al.align(rows(*data), *FILES), types)) == want
    assert al.score(al.align(rows((1, "a")).limit(0), *FILES), types).count() == 0


def test_query_equals_brute_force(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(registered.op12_alignment(spark, folder)) == brute(docs)


def test_joined_segments_equal_single_ones():
    segments = list(dict.fromkeys(["½", "plain", "soft\u00adhyphen", "Ñandú.%%%", "<|endoftext|>", "<s>", "ĳ²", "a" * 900, "two  spaces", "日本", "x\ny",
                                   *(f"word{i}," for i in range(1_200)), "ª", "last"]))
    assert PAIR._encode(segments) == PAIR._each(segments)


def test_halving_leaves_out_what_cannot_be_told_apart():
    segments = [f"w{i}" for i in range(9)] + ["inner space", "x▁y", "end"]
    found = dict(PAIR._joined(segments))
    assert found == {s: v for s, v in zip(segments, PAIR._each(segments)) if s[0] != "i" and s[1] != "▁"}
