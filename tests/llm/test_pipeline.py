"""The pipeline against brute force on the smallest given tables."""

from array import array
from collections import Counter

import public_tokenizers
import tiktoken
from test_ngram_join import brute

import corpus_pipeline
from cohortloom.llm import byte_bpe, mixing, ngram_join, pii, toxicity
from cohortloom.llm.rows import table
from cohortloom.session import settle


def test_every_stage_equals_its_brute_force(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")  # enough labels for the scorer to act
    docs = table(spark, folder, "documents")
    columns = docs.columns
    kept = {}
    frames = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, folder))
        frames[name], kept[name] = docs, docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
    start = {r.doc_id: r for r in frames["input"].collect()}

    scorer = toxicity.Scorer(toxicity.fit(frames["input"], table(spark, folder, "labels")))
    clean = {i for i, r in start.items() if scorer(r.text) < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept["toxicity"]} == clean and len(clean) < len(start)

    groups = brute([(i, start[i].text) for i in sorted(clean)])
    firsts = {component for _, _, component in groups}
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(firsts)

    finder = pii.Finder(pii.train(pii.labelled_table()))
    for r in kept["pii"]:
        assert r.text == pii.redact(start[r.doc_id].text, finder([start[r.doc_id].text])[0][1]) and r.n_chars == len(r.text)
    assert {r.doc_id for r in kept["pii"]} == firsts

    uses = Counter(r.doc_id for r in mixing.mix(frames["pii"]).collect())
    assert Counter(r.doc_id for r in kept["mixing"]) == uses and set(uses) == firsts and max(uses.values()) == 2

    ranks = byte_bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    peer = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in kept["pii"]}
    assert Counter(r.doc_id for r in kept["byte_bpe"]) == uses
    for r in kept["byte_bpe"]:
        assert list(array("I", r.ids)) == peer.encode_ordinary(texts[r.doc_id])


def test_deduplicated_keeps_one_row_of_each_group(rows):
    df = rows((5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (3, "other words here"), (None, "a b c d e f"), (None, "lonely"), (8, None), (9, ""))
    found = ngram_join.deduplicated(df)
    assert found.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in found.collect()) == sorted(
        [("3", "A b c d e f"), ("3", "other words here"), ("None", "lonely"), ("8", "None"), ("9", "")])


def test_run_returns_ids(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "n_tokens", "ids"]
