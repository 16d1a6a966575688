"""Near-duplicate vectors against all pairs by numpy, and the stated cases."""

import numpy as np

from glyphmill.llm import embedding_dedup


def corpus(n=600, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    out = [base[rng.integers(len(base))] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.2]) for _ in range(n)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


def brute(rows, t=0.95):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= t
    root = np.arange(len(rows))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(rows))])
        if (new == root).all():
            return {i: int(r) for i, r in enumerate(root)}
        root = new


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {r["vec_id"]: r["group_id"] for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == brute(rows)


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 48)).astype(np.float32)
    y = (x + 0.4 * rng.standard_normal(x.shape)).astype(np.float32)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    errors, outside = [], 0
    for seed in range(8):
        rot = embedding_dedup.rotation(48, 192, seed)
        code, factor = embedding_dedup.encode(x, rot)
        query, scale = embedding_dedup.round_query(y, seed)
        est = embedding_dedup.estimates(code, factor, query, scale, rot).diagonal()
        true = (x * y).sum(axis=1)
        errors.append(est - true)
        outside += (np.abs(est - true) > embedding_dedup.error_bound(factor, 192, 4.0)).sum()
    assert abs(np.mean(errors)) < 0.003 and outside <= 3


def test_defined_results(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a), (2, [2.0, 0.0, 0.0, 0.0]), (3, b), (3, b), (3, a), (None, a), (4, None), (5, []), (6, [0.0] * 4), (7, [float("nan"), 1.0, 0.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, group_id long")
    got = {r["vec_id"]: (r["group_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (1, False), 9: (9, True)}
    assert embedding_dedup.near_duplicate_vectors(df.where("false")).count() == 0
