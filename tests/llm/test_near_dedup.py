"""Near-duplicate groups against exact Jaccard by loops, and the stated cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import near_dedup


def shingles(text, k=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, t=0.5):
    """Least doc_id of the group of each doc_id."""
    rows = [(d, x) for d, x in rows if d is not None and x is not None]
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = [(d, x.lower(), shingles(x)) for d, x in rows]
    for i, (a, x, s) in enumerate(sets):
        for b, y, u in sets[:i]:
            if x == y or (s and u and len(s & u) >= t * len(s | u)):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.choice([1, 2, 5, 30, 80, 300])) for _ in range(25)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(int(len(text) * rng.choice([0, 0.01, 0.03]))):  # far from the threshold on either side
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("together", [near_dedup.TOGETHER, 4])
def test_groups_equal_brute_force(spark, together):
    """With buckets whole, and cut into blocks."""
    rows = corpus(7)
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), together=together).collect()}
    assert got == brute(rows)


def test_defined_results(spark):
    long = " ".join(f"z{i}" for i in range(20000))
    rows = [
        (None, "a b c d e", 1), (1, None, 2), (2, "", 3), (3, "", 4), (4, "...", 5), (5, "A b c d e", 6), (6, "a B c d e", 7), (6, "a B c d e", 7),
        (7, long, 8), (8, long + " more", 9), (9, "alone in the world", 10), (9, "alone in the world", 11), (9, "another text of that number", 12),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    for c in ("gm_node", "gm_row", "id", "digest", "__gm_row"):
        df = df.withColumn(c, F.col("x"))
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r["gm_node"] == r["gm_row"] == r["id"] == r["digest"] == r["__gm_row"] == r["x"] for r in got)
    want = {(None, "a b c d e"), (1, None), (2, ""), (4, "..."), (5, "A b c d e"), (7, long), (9, "alone in the world"), (9, "another text of that number")}
    assert len(got) == len(want) and {(r["doc_id"], r["text"]) for r in got} == want
    assert near_dedup.drop_near_duplicates(df.where("false")).count() == 0 and near_dedup.near_duplicate_groups(df.where("false")).count() == 0
    with pytest.raises(TypeError):
        near_dedup.drop_near_duplicates(df, treshold=0.7)


def test_only_texts_with_a_candidate_are_shuffled(spark, monkeypatch):
    """Texts that no other resembles are left out before the exact verification."""
    asked = []
    may_have = near_dedup.may_have

    def noted(keys, *columns):
        asked.append({r[0] for r in keys.collect()})
        return may_have(keys, *columns)

    monkeypatch.setattr(near_dedup, "may_have", noted)
    alone = [(i, " ".join(f"d{i}x{j}" for j in range(30))) for i in range(50)]
    rows = [*alone, (50, alone[7][1] + " more"), (51, alone[9][1] + " words")]
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert asked == [{7, 9, 50, 51}]
