"""Jump consistent hashing against the sequence by loops, movement, and the stated cases."""

import hashlib

import numpy as np
import pytest

from glyphmill.llm import sharding


def brute(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def key_of(text):
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


@pytest.mark.parametrize("shards", [1, 2, 7, 256, 100_000])
def test_jump(shards):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    assert sharding.jump(keys, shards).tolist() == [brute(int(k), shards) for k in keys]


def test_only_the_least_share_moves_and_only_to_new_shards():
    keys = sharding.textnum.mix(np.arange(200_000, dtype=np.uint64))
    before, after = sharding.jump(keys, 40), sharding.jump(keys, 50)
    moved = before != after
    assert (after[moved] >= 40).all() and abs(moved.mean() - 10 / 50) < 0.005
    counts = np.bincount(after, minlength=50)
    assert counts.min() > 0.9 * counts.mean() and counts.max() < 1.1 * counts.mean()


def test_defined_results(spark):
    rows = [(1, "a", 5), (1, "a", 5), (2, "x" * 200_000, None), (None, None, 7), (None, "", 8), (3, None, 9)]
    df = spark.createDataFrame([(a, b, c, c, c) for a, b, c in rows], "doc_id long, text string, shard int, gm_shard int, gm_part int")
    out = sharding.assign_shards(df, ["doc_id"], 10, appended=5)
    assert out.columns == ["doc_id", "text", "gm_shard", "gm_part", "shard", "shard_after", "moved"]
    got = out.collect()
    assert len(got) == 6 and all(r["gm_shard"] == r["gm_part"] for r in got)
    for r in got:
        want = (brute(key_of(str(r["doc_id"])), 10), brute(key_of(str(r["doc_id"])), 15)) if r["doc_id"] is not None else (brute(0, 10), brute(0, 15))
        assert (r["shard"], r["shard_after"], r["moved"]) == (*want, want[0] != want[1])
    two = {(r["doc_id"], r["text"]): r["shard"] for r in sharding.assign_shards(df, ["doc_id", "text"], 1000).collect()}
    assert two[None, None] == brute(0, 1000) and two[None, ""] != two[None, None]
    assert sharding.assign_shards(df.where("false"), ["doc_id"], 10).count() == 0
