"""BPE against merging by brute force, a compiled library, and exact round trips."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PythonException

from glyphmill.llm import bpe

RAW = bpe.read_vocabulary(bpe.VOCABULARY)
CODEC = bpe.Codec(RAW)
TEXTS = ["", " ", "plain words, and 1234 numbers", "Grüße, 世界 \U0001f600\n\n x", "a" * 300, "\x00\x01\x7f", "it's we'll  they've\t\n end ", "zzzxqqqj" * 40]


def brute(piece):
    """The pair of least rank merges first, the leftmost of equals, until none is left."""
    parts = [bytes([b]) for b in piece]
    while True:
        ranks = [CODEC.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return [CODEC.ranks[p] for p in parts]
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def corpus():
    return TEXTS + [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t][:60]


def test_merges_equal_brute_force():
    for text in TEXTS + corpus()[8:20]:
        assert CODEC.encode(text) == [t for p in CODEC.pieces(text) for t in brute(p.encode())]


def test_compiled_ids_are_the_same():
    encode = bpe.compiled(RAW, bpe.PATTERN)
    for text in corpus():
        assert np.array_equal(encode(text), CODEC.encode(text))


def test_round_trip_and_defined_results(spark):
    rows = [(i, t, i, i) for i, t in enumerate(corpus())] + [(None, None, 1, 1), (3, "x", 3, 3), (3, "x", 3, 3), (9000, "word " * 200_000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, gm_text long")
    out = bpe.encode(df, verify=True)
    assert out.columns == ["doc_id", "gm_text", "token_ids", "n_tokens", "round_trip"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got if r["token_ids"] is not None)
    assert [(r["token_ids"], r["n_tokens"], r["round_trip"]) for r in got if r["doc_id"] is None] == [(None, None, None)]
    assert [tuple(r)[2:] for r in got if r["doc_id"] == 0] == [([], 0, True)]
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in got if r["token_ids"] is not None)
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(out).collect()}
    assert back == {(r[0], r[1]) for r in rows}
    assert bpe.encode(df.where("false")).count() == 0 and bpe.decode(out.where("false")).count() == 0


@pytest.mark.parametrize("ids", [[-1], [len(CODEC.vocabulary)], [0, None]])
def test_ids_outside_the_vocabulary_are_errors(spark, ids):
    df = spark.createDataFrame([(ids,)], "token_ids array<int>")
    with pytest.raises(PythonException):
        bpe.decode(df).collect()


def test_a_character_cut_in_two_decodes_to_replacements(spark):
    ids = CODEC.encode("\U0001f600")
    assert len(ids) > 1
    df = spark.createDataFrame([(ids[:1],), (None,), ([],)], "token_ids array<int>")
    assert [r[0] for r in bpe.decode(df).orderBy("text").collect()][:2] == [None, ""]
