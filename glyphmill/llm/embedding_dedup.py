"""Operator 6: near-duplicate embeddings with randomised-rotation binary codes.

Unit vectors are padded, rotated by a random orthogonal matrix and kept as sign
bits with a correction factor, the inner product of the vector with its own
code.  For a pair, the code's inner product with the other vector (8-bit, with
randomised rounding) divided by the factor is an unbiased estimate of the
cosine, with an error of about sqrt((1 - f^2) / (f^2 (bits - 1))).  Only pairs
whose upper confidence bound reaches the threshold are recomputed exactly, on
the stored vectors.

Candidates share a bucket of one of several hyperplane tables.  The bits of a
table grow with the logarithm of the number of vectors, so that buckets keep
their size, and the number of tables follows from the chosen recall at the
threshold.  Exact copies collapse first.  Buckets above `BLOCK` vectors are cut
into blocks, and all pairs of blocks are compared.

Defined results
---------------
* Take no part: null vec_id; null, empty or all-zero embedding; null, infinite
  or NaN components; a length other than the most frequent one (ties: the
  longer).
* Rows that share a vec_id are one item with several vectors; repeated rows
  change nothing.  A vec_id alone is its own group.
* Ties: the least vec_id of a group represents it and is kept.
* Further columns aren't read.  Texts don't occur.
* Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.common import Workspace, connected_components

BLOCK = 4096
BUCKET = 128  # vectors that a bucket holds on average


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """(dim, bits) with orthonormal rows: pads and rotates."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r))).T[:dim].astype(np.float32)


def encode(unit: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction factor) of each unit vector."""
    z = unit @ rot
    return np.packbits(z > 0, axis=1), np.abs(z).sum(axis=1) / math.sqrt(rot.shape[1])


def round_query(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """8-bit vectors and their scale, rounded up or down at random so that the mean is exact."""
    scale = np.abs(unit).max(axis=1) / 127
    noise = np.random.default_rng(seed).random(unit.shape[1], dtype=np.float32)
    return np.clip(np.floor(unit / scale[:, None] + noise), -127, 127).astype(np.int8), scale.astype(np.float32)


def estimates(codes: np.ndarray, factor: np.ndarray, query: np.ndarray, scale: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """Estimated cosine of every coded vector (rows) with every query (columns)."""
    bits = rot.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    z = (query.astype(np.float32) * scale[:, None]) @ rot
    return (signs @ z.T) / (math.sqrt(bits) * factor)[:, None]


def error_bound(factor: np.ndarray, bits: int, sigmas: float) -> np.ndarray:
    return sigmas * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * (bits - 1)))


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, unit vectors) of the rows that take part."""
    col = batch.column(1)
    size = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    flat = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    ok = np.isfinite(norm) & (norm > 0)
    return batch.column(0).to_numpy(zero_copy_only=False)[rows][ok].astype(np.int64), x[ok] / norm[ok][:, None]


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _pairs_in_buckets(rot: np.ndarray, threshold: float, sigmas: float, dim: int):
    bits = rot.shape[1]

    def pairs(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        est = estimates(c["code"][a], c["factor"][a], c["query"][b], c["scale"][b], rot)
        hit = est + error_bound(c["factor"][a], bits, sigmas)[:, None] >= threshold
        i, j = np.nonzero(np.triu(hit, 1) if same else hit)
        x, y = c["id"][a[i]], c["id"][b[j]]
        ok = x != y
        yield pa.record_batch({"a": np.minimum(x, y)[ok], "b": np.maximum(x, y)[ok]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        c = {n: t[n].to_numpy() for n in ("key", "lo", "hi", "mine", "id", "factor", "scale")}
        order = np.lexsort((c["id"], c["mine"], c["hi"], c["lo"], c["key"]))
        c = {n: v[order] for n, v in c.items()}
        c["code"] = textnum.string_buffers(t["code"])[0].reshape(-1, bits // 8)[order]
        c["query"] = textnum.string_buffers(t["query"])[0].view(np.int8).reshape(-1, dim)[order]
        new = np.zeros(len(order), dtype=bool)
        new[0] = True
        for n in ("key", "lo", "hi"):
            new[1:] |= c[n][1:] != c[n][:-1]
        start = np.flatnonzero(new)
        for s, e in zip(start, np.append(start[1:], len(order))):
            if e - s < 2:
                continue
            rows = np.arange(s, e)
            if c["lo"][s] == c["hi"][s]:
                yield from pairs(c, rows, rows, True)
            else:
                first = c["mine"][s:e] == c["lo"][s]
                yield from pairs(c, rows[first], rows[~first], False)

    return run


def _exact(threshold: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (textnum.string_buffers(b.column(i))[0].view(np.float64).reshape(-1, dim) for i in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y)
            ok = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cosine)], names=["a", "b", "cosine"]).filter(ok)

    return run


def _prepare(ws: Workspace, vectors: DataFrame, threshold: float, bits_per_dim: int, recall: float, sigmas: float, seed: int):
    """(near pairs of representatives, (id, rep) of all that take part), as tables."""
    base = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x")).where(
        "id is not null and size(x) > 0"
    )
    sizes = base.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return None
    dim = sizes[0]["dim"]

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = _vectors(batch, dim)
            digest = [hashlib.blake2b(np.round(r, 12).tobytes(), digest_size=16).digest() for r in unit]
            yield pa.record_batch({"id": pa.array(ids), "digest": pa.array(digest, pa.binary()), "unit": _binary(unit)})

    units = ws.save(base.mapInArrow(normalise, "id long, digest binary, unit binary"), "units")
    reps = units.groupBy("digest").agg(F.min("id").alias("rep"))
    members = ws.save(units.select("id", "digest").join(reps, "digest").select("id", "rep").distinct(), "members")
    own = ws.save(units.join(reps, "digest").where("id = rep").dropDuplicates(["digest"]).select("id", "unit"), "representatives")
    n = own.count()
    bits = max(8, -(-dim * bits_per_dim // 64) * 64)
    rot = rotation(dim, bits, seed)
    width = max(4, math.ceil(math.log2(max(n, 2) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** width
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree))
    planes = np.random.default_rng(seed + 1).standard_normal((dim, tables * width))
    weight = (np.int64(1) << np.arange(width)).astype(np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = textnum.string_buffers(batch.column(1))[0].view(np.float64).reshape(-1, dim)
            codes, factor = encode(unit.astype(np.float32), rot)
            query, scale = round_query(unit.astype(np.float32), seed + 2)
            side = ((unit @ planes) > 0).reshape(-1, tables, width) @ weight
            side = (np.arange(tables, dtype=np.int64) << 40) + side
            keys = pa.ListArray.from_arrays(np.arange(0, side.size + 1, tables, dtype=np.int32), pa.array(side.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _binary(codes), pa.array(factor.astype(np.float64)), _binary(query), pa.array(scale.astype(np.float64)), keys],
                names=["id", "code", "factor", "query", "scale", "keys"],
            )

    coded = ws.save(own.mapInArrow(code, "id long, code binary, factor double, query binary, scale double, keys array<long>"), "codes")
    rows = coded.withColumn("key", F.explode("keys")).drop("keys")
    large = (
        coded.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > BLOCK)
        .select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    rows = (
        rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "code", "factor", "query", "scale")
    )
    pairs = (
        rows.repartition("key", "lo", "hi").mapInArrow(_pairs_in_buckets(rot, threshold, sigmas, dim), "a long, b long").distinct()
    )
    left = own.select(F.col("id").alias("a"), F.col("unit").alias("ua"))
    right = own.select(F.col("id").alias("b"), F.col("unit").alias("ub"))
    near = ws.save(
        pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(_exact(threshold, dim), "a long, b long, cosine double"),
        "near",
    )
    ws.drop(units, coded)
    return near, members


_NO_PAIRS, _NO_GROUPS = "vec_a long, vec_b long, cosine double", "vec_id long, group_id long, kept boolean"


def near_pairs(
    vectors: DataFrame, *, threshold: float = 0.95, bits_per_dim: int = 4, recall: float = 0.999, sigmas: float = 4.0, seed: int = 11
) -> DataFrame:
    """(vec_a, vec_b, cosine) of the pairs of different vectors whose cosine reaches the threshold; exact copies as one."""
    found = _prepare(Workspace(vectors.sparkSession, "embeddings"), vectors, threshold, bits_per_dim, recall, sigmas, seed)
    if found is None:
        return vectors.sparkSession.createDataFrame([], _NO_PAIRS)
    return found[0].groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumnsRenamed({"a": "vec_a", "b": "vec_b"})


def near_duplicate_vectors(
    vectors: DataFrame, *, threshold: float = 0.95, bits_per_dim: int = 4, recall: float = 0.999, sigmas: float = 4.0, seed: int = 11
) -> DataFrame:
    """(vec_id, group_id, kept) of every vec_id that takes part; groups are the connected components of near pairs."""
    ws = Workspace(vectors.sparkSession, "embeddings")
    found = _prepare(ws, vectors, threshold, bits_per_dim, recall, sigmas, seed)
    if found is None:
        return vectors.sparkSession.createDataFrame([], _NO_GROUPS)
    near, members = found
    copies = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = connected_components(ws, near.select("a", "b").union(copies), "a", "b")
    ids = members.select(F.col("id").alias("vec_id")).distinct()
    group = F.coalesce("root", "vec_id")
    return ids.join(roots, F.col("vec_id") == F.col("node"), "left").select("vec_id", group.alias("group_id"), (group == F.col("vec_id")).alias("kept"))
