"""Mixing against brute force: packing, draws, permutations and shares."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import bpe, mixing

OPTIONS = {"block_tokens": 16, "shard_blocks": 64}
SCHEMA = "doc_id long, text string, source string"


def words(n, at=0):
    return " ".join(f"w{i}" for i in range(at, at + n))


def documents(spark, large):
    """A small source, a null one, one without text, and one of the given number of documents."""
    rows = [(i, words(10, i), "small") for i in range(60)] + [(1000 + i, words(20), None) for i in range(20)] + [(7001, "", "blank"), (7002, None, "small")]
    return spark.createDataFrame(rows + [(2000 + i, words(50), "large") for i in range(large)], SCHEMA)


CODEC = bpe.Codec(bpe.read_vocabulary(bpe.VOCABULARY))
ids_of = CODEC.encode


def blocks(spark, large):
    """(number of blocks, tokens of all, tokens of the shortest) by source, of the distinct blocks drawn."""
    out = mixing.mix_blocks(documents(spark, large), total_blocks=4000, weights={"small": 1, None: 1, "large": 1}, **OPTIONS)
    found = out.select("source", "index", "n_tokens").distinct().groupBy("source").agg(F.count("*"), F.sum("n_tokens"), F.sum(F.expr("int(n_tokens < 16)")))
    return {r[0]: (r[1], r[2], r[3]) for r in found.collect()}


def test_small_sources_keep_their_blocks_when_others_grow(spark):
    few, many = blocks(spark, 10), blocks(spark, 600)
    for source, texts in (("small", [words(10, i) for i in range(60)]), (None, [words(20)] * 20)):
        n = sum(len(ids_of(t)) for t in texts)
        assert few[source] == many[source] == (-(-n // 16), n, int(n % 16 > 0))


def test_blocks_hold_the_tokens_of_their_documents_in_order(spark):
    """Every block of a source, in order, gives the tokens of all its documents, each whole and in one run."""
    rows = documents(spark, 40).repartition(5)
    out = mixing.mix_blocks(rows, total_blocks=6000, temperature=1e9, **OPTIONS).collect()
    of, docs = defaultdict(dict), {}
    for r in out:
        assert r["n_tokens"] == len(r["token_ids"]) <= 16
        assert of[r["source"]].setdefault(r["index"], (r["token_ids"], r["doc_ids"])) == (r["token_ids"], r["doc_ids"])
    for r in rows.collect():
        docs[r["doc_id"], r["source"]] = r["text"]
    for source, found in of.items():
        assert sorted(found) == list(range(len(found)))  # all blocks are drawn
        flat = [t for i in sorted(found) for t in found[i][0]]
        order = list(dict.fromkeys(d for i in sorted(found) for d in found[i][1]))
        assert flat == [t for d in order for t in ids_of(docs[d, source])]
    assert Counter(s for _, s in docs)["blank"] == 1 and "blank" not in of


def test_draws_and_permutations_are_those_of_the_definition(spark):
    docs = documents(spark, 40)
    out = mixing.mix_blocks(docs, total_blocks=300, weights={"small": 3, None: 1, "large": 2}, **OPTIONS).collect()
    assert len(out) == 300 and len({(r["shard"], r["place"]) for r in out}) == 300
    names = [None, "large", "small"]
    n = {s: max(r["index"] for r in mixing.mix_blocks(docs, total_blocks=9000, temperature=1e9, **OPTIONS).collect() if r["source"] == s) + 1 for s in names}
    got, slot = defaultdict(list), Counter()
    for r in out:
        got[r["shard"], r["source"]].append((r["epoch"], r["index"]))
    for shard in range(5):
        counts = np.random.default_rng([7, shard]).multinomial(64 if shard < 4 else 44, np.array([1, 2, 3]) / 6)
        for i, s in enumerate(names):
            want = []
            for j in range(slot[s], slot[s] + counts[i]):
                key = mixing.textnum.mix(_key(i, j // n[s]))
                want.append((j // n[s], int(mixing.permute(np.array([j % n[s]]), np.array([n[s]]), key)[0])))
            slot[s] += counts[i]
            assert sorted(got[shard, s]) == sorted(want)


def _key(source, epoch):
    return np.array([(source * 0x9E3779B97F4A7C15 + epoch + (7 << 20)) % (1 << 64)], dtype=np.uint64)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutations_hit_every_index_once(n):
    out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 99))
    assert sorted(out.tolist()) == list(range(n))


def test_pieces_give_back_the_texts(spark):
    texts = ["Grüße, 世界 \U0001f600 und mehr " * 9, "plain text of some length " * 20, "", None, "\U0001f600" * 50]
    rows = [(i, t, "one", i, i, i) for i, t in enumerate(texts)] + [(1, texts[1], "one", 1, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_chars int, e0 int, body int")
    out = mixing.mix_documents(docs, block_tokens=7, shard_blocks=64)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r["e0"] == r["body"] == r["doc_id"] and r["n_chars"] == len(r["text"]) for r in got)
    assert sum(len(r["text"]) for r in got) == sum(len(r[1]) for r in rows if r[1])
    for i, t in enumerate(texts):
        pieces = [r["text"] for r in got if r["doc_id"] == i]
        assert Counter("".join(pieces)) == Counter((t or "") * (2 if i == 1 else 1)) and all(p in t for p in pieces)


def test_weights_must_name_the_sources(spark):
    docs = documents(spark, 3)
    for weights in ({"small": 1}, {"small": 1, "large": 1, None: 1, "other": 1}, {"small": -1, "large": 1, None: 1}, {"small": 0, "large": 0, None: 0}):
        with pytest.raises(ValueError):
            mixing.mix_blocks(docs, weights=weights, **OPTIONS)
    out = mixing.mix_blocks(docs, weights={"small": 1, "large": 0, None: 0}, **OPTIONS)
    assert {r["source"] for r in out.select("source").distinct().collect()} == {"small"}


def test_empty_table_and_no_tokens(spark):
    docs = documents(spark, 0)
    assert mixing.mix_blocks(docs.where("false"), **OPTIONS).count() == 0
    assert mixing.mix_blocks(docs.where("source = 'blank'"), **OPTIONS).count() == 0
    assert mixing.mix_documents(docs.where("source is null"), **OPTIONS).count() > 0
