"""Operator 4: MinHash near-duplicate groups with sequential Bayesian verification.

Candidates come from banded MinHash signatures.  For a candidate pair the
signatures are compared in batches of hashes; after m agreements in n hashes
the similarity has the posterior Beta(m + 1, n - m + 1), and the pair is
pruned as soon as P(similarity >= threshold) falls below the chosen miss
probability.  What survives all batches is verified exactly, on the shingle
sets of the whole texts.

With 54 bands of 3 hashes, a pair at the threshold of 0.5 shares no bucket with
probability 0.0007 (less above it), which comes on top of the chosen one.

Pairs inside a bucket that are already joined by links whose posterior
probability of lying under the threshold is below `link_error` aren't emitted
again; every other pair is compared.  So large groups of copies cost about one
comparison a member and no pair is capped away.  Buckets above `TOGETHER`
documents aren't gathered into one task: they are cut into blocks, and every two
blocks are compared in a task of their own.

Defined results
---------------
* A row whose doc_id or text is null takes no part: it has no group and stays.
* A text without words (empty, white space, punctuation) is only equal to the
  byte-identical text (after lower-casing).
* Repeated rows: rows that share a doc_id are one document with several texts,
  near another if any of its texts is.  Of the rows that agree in doc_id and
  text, `drop_near_duplicates` keeps the one whose columns have the least hash.
* Ties: the least doc_id of a group is its representative and stays.
* Further columns pass through `drop_near_duplicates` untouched, whatever their
  names; `near_duplicate_groups` doesn't return them.
* An empty table has no groups.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.common import Workspace, connected_components, free_names, group_bounds, grouped, may_have

HASHES, ROWS = 162, 3
BATCH = 18
TOGETHER = 20_000  # documents of a bucket that are compared in one task
SLICE = 1 << 18

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature matrix of 16-bit values, rows that have words)."""
    n = len(off) - 1
    sig = np.zeros((n, HASHES), dtype=np.uint16)
    has = np.zeros(n, dtype=bool)
    for lo, hi in textnum.slices(off, SLICE):
        h, r = textnum.shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
        if not len(h):
            continue
        x = (h >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        at = r[first] + lo
        has[at] = True
        for j in range(HASHES):
            low = np.minimum.reduceat((x ^ _XOR[j]) * _MUL[j], first)
            low ^= low >> np.uint32(15)
            sig[at, j] = (low * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)
    return sig, has


@lru_cache
def posterior_at_least(m: int, n: int, t: float) -> float:
    """P(similarity >= t) under Beta(m + 1, n - m + 1); equals P(Binomial(n + 1, t) <= m)."""
    return math.fsum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))


@lru_cache
def stopping_rule(t: float, miss: float, link_error: float) -> tuple[tuple[int, ...], int]:
    """Least agreements that survive each batch, and least agreements of all hashes that make a sure link."""
    least = tuple(
        next(m for m in range(n + 2) if m > n or posterior_at_least(m, n, t) >= miss)
        for n in range(BATCH, HASHES + 1, BATCH)
    )
    sure = next(m for m in range(HASHES + 2) if m > HASHES or 1 - posterior_at_least(m, HASHES, t) <= link_error)
    return least, sure


def compare(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (a, b) that survive every batch, and their agreements."""
    live = np.arange(len(a))
    agree = np.zeros(len(a), dtype=np.int32)
    for i, m in enumerate(least):
        s = slice(i * BATCH, (i + 1) * BATCH)
        agree = agree + (sig[a[live], s] == sig[b[live], s]).sum(axis=1, dtype=np.int32)
        ok = agree >= m
        live, agree = live[ok], agree[ok]
        if not len(live):
            break
    return live, agree


def bucket_edges(ids: np.ndarray, sig: np.ndarray, rule: tuple[tuple[int, ...], int]) -> list[tuple[int, int]]:
    """Surviving pairs of one bucket; pairs already joined by sure links are left out."""
    least, sure = rule
    n = len(ids)
    parent = np.arange(n)  # label of the sure component; relabelled in full on a merge
    out: list[tuple[int, int]] = []
    for i in range(n - 1):
        # members that are sure to belong to i's component need no comparison with i
        other = np.flatnonzero(parent[i + 1 :] != parent[i]) + i + 1
        if not len(other):
            continue
        live, agree = compare(sig, np.full(len(other), i), other, least)
        for j, m in zip(other[live], agree):
            if parent[i] == parent[j] or ids[i] == ids[j]:
                continue
            out.append((int(ids[i]), int(ids[j])))
            if m >= sure:
                parent[parent == parent[j]] = parent[i]
    return out


def _edge_worker(rule: tuple[tuple[int, ...], int]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def fn(t: pa.Table) -> pa.Table:
        bounds = group_bounds(t, ["bkt"])
        ids = t["id"].to_numpy()
        raw, _ = textnum.string_buffers(t["sig"])
        sig = raw.view(np.uint16).reshape(-1, HASHES) if len(raw) else np.zeros((0, HASHES), np.uint16)
        size = np.diff(bounds)
        pairs: list[np.ndarray] = []
        two = bounds[:-1][size == 2]
        if len(two):  # by far the most buckets: all of them at once
            live, _ = compare(sig, two, two + 1, rule[0])
            pairs.append(np.stack([ids[two[live]], ids[two[live] + 1]], axis=1))
        for lo, hi in zip(bounds[:-1][size > 2], bounds[1:][size > 2]):
            if e := bucket_edges(ids[lo:hi], sig[lo:hi], rule):
                pairs.append(np.array(e, dtype=np.int64))
        p = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        p = np.unique(np.sort(p, axis=1), axis=0)
        p = p[p[:, 0] != p[:, 1]]
        return pa.table({"a": p[:, 0], "b": p[:, 1]})

    return grouped(["bkt"], fn, schema)


def _verify_worker(k: int, threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(t: pa.Table) -> list[np.ndarray]:
        buf, off = textnum.string_buffers(t["text"])
        out: list[np.ndarray] = []
        for lo, hi in textnum.slices(off, SLICE):
            h, r = textnum.shingles(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
            cut = np.searchsorted(r, np.arange(1, hi - lo))
            out += [np.unique(x) for x in np.split(h, cut)]
        return out

    def run(batches):
        hub, hub_sets = None, []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            hubs, leaf, ids = t["hub"].to_numpy(), t["leaf"].to_numpy(), t["id"].to_numpy()
            parts = t["part"].to_numpy()
            a, b = [], []
            for i, s in enumerate(sets(t)):
                here = (hubs[i], parts[i])
                if here != hub:
                    hub, hub_sets = here, []
                if not leaf[i]:
                    hub_sets.append(s)
                    continue
                for h in hub_sets:
                    both = len(np.intersect1d(s, h, assume_unique=True))
                    if both >= threshold * (len(s) + len(h) - both) and both:
                        a.append(hubs[i])
                        b.append(ids[i])
                        break
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, schema=schema)

    return run


def near_duplicate_groups(
    docs: DataFrame, *, threshold: float = 0.5, shingle: int = 3, miss: float = 0.001, link_error: float = 1e-6, together: int = TOGETHER
) -> DataFrame:
    """(doc_id, group_id, kept) of every distinct non-null doc_id that has a text.

    group_id is the least doc_id of the group of near-copies; a document alone
    is its own group.  kept is true for one document of each group.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    roots, exact, _ = _roots(ws, docs, threshold, shingle, miss, link_error, together)
    return _grouped_ids(exact, roots).select(
        "doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept")
    )


def _grouped_ids(exact: DataFrame, roots: DataFrame) -> DataFrame:
    ids = exact.groupBy(F.col("id").alias("doc_id")).agg(F.min("rep").alias("rep"))
    return ids.join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("group_id")
    )


def _roots(ws: Workspace, docs: DataFrame, threshold: float, shingle: int, miss: float, link_error: float, together: int):
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower(F.col("text").cast("string")).alias("text")).where(
        "id is not null and text is not null"
    )
    # Exact copies collapse first, on a 128-bit digest: only representatives get signatures.
    digests = ws.save(base.select("id", F.unhex(F.md5("text")).alias("digest")), "digests")
    reps = digests.groupBy("digest").agg(F.min("id").alias("rep"))
    exact = ws.save(digests.join(reps, "digest").groupBy("id", "digest", "rep").count(), "exact")

    def sign(batches):
        for batch in batches:
            buf, off = textnum.string_buffers(batch.column(1))
            sig, has = signatures(buf, off, shingle)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[has]
            flat = np.ascontiguousarray(sig[has]).view(np.uint8).reshape(-1)
            width = 2 * HASHES
            offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
            col = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.record_batch([pa.array(ids, pa.int64()), col], names=["id", "sig"])

    # Every copy of a text gets the same signature, so the representative is
    # chosen after signing, on narrow rows, and no text is shuffled here.
    signed = base.mapInArrow(sign, "id long, sig binary")
    rep_ids = exact.select(F.col("rep").alias("id")).distinct()
    sigs = ws.save(signed.join(rep_ids, "id", "left_semi").distinct(), "sigs")
    ws.drop(digests)

    bands = HASHES // ROWS
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(bands)])
    keyed = sigs.select("id", F.explode(keys).alias("key"))
    large = ws.save(keyed.groupBy("key").count().where(F.col("count") > together), "large")
    few = (
        keyed.join(large, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        .where(F.size("ids") > 1)
        .select("ids").distinct()  # bands that hold the same documents are one bucket
        .select(F.xxhash64("ids", F.size("ids")).alias("bkt"), F.explode("ids").alias("id"))
    )
    blocks = F.ceil(F.col("count") * 2 / together).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    many = (
        keyed.join(large, "key").select("key", "id", blocks.alias("blocks")).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("bkt"), "id")
    )
    members = few.union(many)
    rule = stopping_rule(threshold, miss, link_error)
    edges = ws.save(
        members.join(sigs, "id")
        .repartition("bkt").sortWithinPartitions("bkt", "id")
        .mapInArrow(_edge_worker(rule), "a long, b long").distinct(),
        "survivors",
    )

    # Exact verification: a text travels once per hub that it is compared with.
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / 2000).cast("int").alias("parts"))
    links = edges.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    ends = links.select(F.col("a").alias("hub"), "part", F.lit(1).alias("leaf"), F.col("b").alias("id")).union(
        links.select(F.col("a").alias("hub"), "part", F.lit(0).alias("leaf"), F.col("a").alias("id")).distinct()
    )
    verified = (
        base.where(may_have(ends.select("id"), F.col("id"))).join(ends, "id")  # other texts aren't shuffled
        .repartition("hub", "part").sortWithinPartitions("hub", "part", "leaf", "id")
        .select("hub", "part", "leaf", "id", "text")
        .mapInArrow(_verify_worker(shingle, threshold), "a long, b long").distinct()
    )
    copies = exact.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = connected_components(ws, verified.union(copies), "a", "b")
    ws.drop(sigs, edges, large)
    return roots, exact, exact.where(F.col("count") > 1).select("id")


def drop_near_duplicates(
    docs: DataFrame, *, threshold: float = 0.5, shingle: int = 3, miss: float = 0.001, link_error: float = 1e-6, together: int = TOGETHER
) -> DataFrame:
    """The rows of `docs`, all columns, without the later members of each group; see the module for the cases.

    Only rows that may go are shuffled.
    """
    ws = Workspace(docs.sparkSession, "near-dedup")
    roots, _, again = _roots(ws, docs, threshold, shingle, miss, link_error, together)
    node, key, digest, row = free_names(docs.columns, "node", "key", "digest", "row")
    removed = roots.select(F.col("node").alias(node))
    keyed = docs.withColumn(key, F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long")))
    may_go = may_have(removed.union(again), F.col(key))
    names = [F.col(f"`{c}`") for c in docs.columns]
    left = keyed.where(may_go).join(removed, F.col(key) == F.col(node), "left_anti")
    # one row of those that agree in doc_id and text; partial aggregation keeps a frequent row from piling up
    rank = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = left.groupBy(F.col(key), F.md5(F.col("text").cast("string")).alias(digest)).agg(F.min_by(F.struct(*names), rank).alias(row))
    return one.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]).union(keyed.where(~may_go).select(*names))
