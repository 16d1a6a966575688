"""Repeated passages against all windows by a dictionary, and the stated cases."""

import random
import re

import pytest

from glyphmill.llm import suffix_dedup

N = 20


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(rows, n=N):
    """(doc, window) of every window that occurred before, by doc_id and place."""
    seen, out = set(), set()
    for doc, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in seen:
                out.add((doc, i))
            seen.add(key)
    return out


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passages = [rng.choices(vocabulary, k=rng.randint(N - 2, 4 * N)) for _ in range(8)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(1, 60))
        rows.append((i, " ".join(text)))
    return [*rows, (docs, " ".join(["same"] * 100)), (docs + 1, " ".join(passages[0] * 3))]


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=N).collect()
    texts = {d: words(t) for d, t in rows}
    got = set()
    for r in found:
        size = r["last_word"] - r["first_word"] + 1
        assert texts[r["doc_id"]][r["first_word"] : r["last_word"] + 1] == texts[r["source_doc_id"]][r["source_word"] : r["source_word"] + size]
        assert (r["source_doc_id"], r["source_word"]) < (r["doc_id"], r["first_word"])
        got |= {(r["doc_id"], i) for i in range(r["first_word"], r["last_word"] - N + 2)}
    assert got == brute(rows)


def test_levels_grow_geometrically():
    import numpy as np

    rng = np.random.default_rng(1)
    family, seen = suffix_dedup.Family(N), {}
    for batch in range(30):
        text = np.concatenate([rng.integers(0, 50, 200, dtype=np.uint32), np.zeros(N + 2, np.uint32)])
        starts = np.arange(180)
        origin = np.stack([np.full(180, batch), np.zeros(180, int), starts], axis=1)
        repeat, _ = family.add(text, starts, origin)
        for i in starts:
            key = tuple(text[i : i + N])
            assert repeat[i] == (key in seen)
            seen.setdefault(key, i)
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_defined_results(spark):
    long = " ".join(f"z{i}" for i in range(30000))
    rows = [(None, long, 1), (1, None, 2), (2, "", 3), (3, long, 4), (4, "Z0 " + long, 5), (4, "Z0 " + long, 5), (5, "too short", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int")
    got = {tuple(r) for r in suffix_dedup.repeated_passages(df).collect()}
    assert got == {(4, 1, 30000, 3, 0)}
    assert suffix_dedup.repeated_passages(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(df, min_words=10)
