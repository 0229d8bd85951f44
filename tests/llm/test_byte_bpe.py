import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import byte_bpe, registered

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.parse_ranks(open(PATH, "rb").read())
ENCODE = byte_bpe.piece_encoder(RANKS)
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def slow(ranks, piece):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40) | st.text(alphabet="aeinrst ", min_size=1, max_size=60).map(str.encode))
def test_a_piece_is_merged_as_by_repeated_search(piece):
    assert ENCODE(piece) == (([RANKS[piece]] if piece in RANKS else slow(RANKS, piece)))


def test_a_new_pair_of_lower_rank_comes_first():
    ranks = {bytes([i]): 1000 + i for i in range(256)} | {b"ab": 700, b"abc": 5, b"bc": 800, b"aa": 9, b"aaa": 3}
    encode, rng = byte_bpe.piece_encoder(ranks), random.Random(5)
    for _ in range(500):
        piece = bytes(rng.choice(b"aabc") for _ in range(rng.randint(2, 20)))
        assert encode(piece) == ([ranks[piece]] if piece in ranks else slow(ranks, piece))


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5_000 + "x", "ab" * 9_000, "é" * 3_000, "!?" * 8_000])
def test_very_long_pieces(text):
    ids = [i for w in __import__("regex").findall(public_tokenizers.PATTERN, text) for i in ENCODE(w.encode())]
    assert ids == PEER.encode_ordinary(text)


def test_rows_are_encoded_and_decoded_whole(rows):
    texts = [None, "", "<|endoftext|> it's  a\n\n test", "日本語 😀 ñandú", "x" * 3000, " \t "]
    df = byte_bpe.encode(rows(*enumerate(texts), (None, "no key"), (0, None)), PATH, public_tokenizers.PATTERN, decoded=True)
    found = df.collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = "no key" if r.doc_id is None else texts[r.doc_id] or ""
        assert list(array("I", r.ids)) == PEER.encode_ordinary(text) and r.decoded.decode() == text and r.n_tokens == len(r.ids) // 4
    assert {bytes(r.decoded) for r in byte_bpe.decode(df, PATH).collect()} == {bytes(r.decoded) for r in found}
    assert byte_bpe.encode(rows((1, "a")).limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_equals_the_peer_library(spark, folder):
    import hashlib
    texts = {r.doc_id: r.text for r in registered.documents(spark, folder, "doc_id", "text").collect()}
    for r in registered.op5_byte_bpe(spark, folder).collect():
        ids = PEER.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
