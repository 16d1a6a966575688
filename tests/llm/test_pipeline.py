"""Stages of the pipeline."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import bpe
from glyphmill.llm.common import Workspace

CODEC = bpe.Codec(bpe.read_vocabulary(bpe.VOCABULARY))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def test_encoded_texts_are_decoded_again(spark):
    out = corpus_pipeline.encode_text(spark, table(spark, ["Grüße, 世界 \U0001f600\n\n x", "", None]), "")
    assert {r["doc_id"]: r["round_trip"] for r in out.collect()} == {0: True, 1: True, 2: None}
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens", "round_trip"]


def test_documents_of_which_nothing_is_left_go(spark):
    line = "one two three four five"
    docs = table(spark, [line, f"{line}\n\n \n", f"{line}\npas : aces", line, "\n\n", None, f"\t{line}\n\n\nmore"])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert out == {0: (line, 23), 2: ("pas : aces", 10), 4: ("\n\n", 2), 5: (None, None), 6: ("\n\nmore", 6)}


def test_stages_one_after_the_other(spark):
    """Each stage works on what the one before kept; the rows of the last are the pieces drawn, decodable to parts of the texts."""
    rng = random.Random(4)
    words = "the of and to in that was it for on are with as his they at be this from have or by one had not but what all were when".split()
    text = lambda k: " ".join(rng.choices(words, k=k))
    texts = [f"{text(40)}\n{text(30)}" for _ in range(40)]
    texts += [texts[0], texts[0].replace(" of ", " or ", 1), f"{texts[1].split(chr(10))[0]}\n{text(50)}", None, "", "これは日本語の文章です。とても短いです。"]
    docs = table(spark, texts)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < len(texts) - 1, F.col("lang")))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, Workspace(spark, "test").save(stage(spark, docs, ""), "stage")
        out[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    assert [r["text"] for r in out["language ID"]].count(None) == 0 and len(texts) - 1 not in {r["doc_id"] for r in out["language ID"]}
    kept = {r["doc_id"]: r["text"] for r in out["line dedup"]}
    assert 40 not in kept and kept[42] == texts[42].split("\n")[1]
    assert {r["doc_id"] for r in out["MinHash near-dedup"]} <= set(kept)
    pieces = out["mixing sources"]
    assert pieces and all(r["text"] in kept[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in pieces)
    last = out["BPE encoding"]
    assert len(last) == len(pieces) and all(r["round_trip"] for r in last)
    assert sorted(CODEC.decode(r["token_ids"]) for r in last) == sorted(r["text"] for r in pieces)


def test_empty_table(spark):
    docs = table(spark, ["x"]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_clashing_columns_and_nulls_pass(spark):
    docs = table(spark, ["the of and to in that was it\nline two of the text", None, "the of and to in that was it"])
    for c in ("gm_key", "gm_node", "doc", "e0", "body", "hash"):
        docs = docs.withColumn(c, docs["doc_id"])
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r["gm_key"] == r["gm_node"] == r["doc"] == r["e0"] == r["doc_id"] for r in out.collect())
