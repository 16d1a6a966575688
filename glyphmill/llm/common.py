"""Shared plumbing of the training-data operators: work tables, grouped Arrow streams, bit tables, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill import storage
from glyphmill.llm.textnum import U64, mix, slices
from glyphmill.storage import BATCH_BYTES, bound_batches


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each changed as far as needed to differ from those taken, without regard to case."""
    used = {t.lower() for t in taken}
    out = []
    for w in wanted:
        name = f"gm_{w}"
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def trim() -> None:
    """Gives freed memory of a Python worker back to the system, at the end of a task: idle workers stay around."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


class Workspace(storage.Workspace):
    """Intermediate tables of an operator of this part."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        super().__init__(spark, name)


def bounded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a column take about BATCH_BYTES each: what a task holds at once doesn't follow from the session."""
    for batch in batches:
        if batch.nbytes <= BATCH_BYTES:
            yield batch
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
        for lo, hi in slices(np.concatenate([[0], np.cumsum(size)]), BATCH_BYTES):
            yield batch.slice(lo, hi - lo)


def grouped(
    key: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls `fn` with tables holding only whole groups of `key`.

    The input partition must be sorted by `key`.  Many small groups reach `fn`
    in one call, which is what keeps the cost per group low.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            out = fn(table)
            if out is not None and out.num_rows:
                yield from out.cast(schema).to_batches(max_chunksize=20000)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            t = pa.Table.from_batches([batch])
            last = [t[k][-1] for k in key]
            cut = t.num_rows
            change = _changes(t, key)
            if len(change):
                cut = int(change[-1])
            else:
                cut = 0
            if cut == 0 and held and [held[-1][k][-1] for k in key] != last:
                yield from emit(pa.concat_tables(held))
                held = []
            if cut:
                yield from emit(pa.concat_tables([*held, t.slice(0, cut)]))
                held = []
            held.append(t.slice(cut))
        if held:
            yield from emit(pa.concat_tables(held))

    return run


def _changes(t: pa.Table, key: list[str]) -> np.ndarray:
    """Row numbers, from 1, whose key differs from that of the row before."""
    diff = np.zeros(max(t.num_rows - 1, 0), dtype=bool)
    for k in key:
        v = t[k].combine_chunks() if isinstance(t[k], pa.ChunkedArray) else t[k]
        v = v.to_numpy(zero_copy_only=False)
        diff |= v[1:] != v[:-1]
    return np.flatnonzero(diff) + 1


def group_bounds(t: pa.Table, key: list[str]) -> np.ndarray:
    """Offsets of the groups of a sorted table, with its length at the end."""
    return np.concatenate([[0], _changes(t, key), [t.num_rows]]).astype(np.int64) if t.num_rows else np.zeros(1, np.int64)


def connected_components(ws: Workspace, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of `edges`; root is the least node of its component.

    Alternates the large-star and small-star operations, each one shuffle of
    narrow rows, until the edges stop changing.  Every round is a written
    table, so that lineage doesn't grow.
    """
    cur = ws.save(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "edges"
    )
    before = None
    while True:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.groupBy("u").agg(F.collect_set("v").alias("n"), F.min("v").alias("m"))
            .withColumn("m", F.least("m", "u"))
            .select(F.explode("n").alias("v"), "m", "u").where("v > u").select(F.col("m").alias("u"), "v")
            .distinct()
        )
        small = (
            large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .groupBy("u").agg(F.collect_set("v").alias("n"), F.min("v").alias("m"))
            .select(F.explode(F.concat("n", F.array("u"))).alias("v"), "m").where("v <> m")
            .select(F.col("m").alias("u"), "v").distinct()
        )
        new = ws.save(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(cur)
        cur = new
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    return cur.select(F.col("v").alias("node"), F.col("u").alias("root"))


#: Bits of the largest table: 32 MB, whatever the data.
MOST_BITS = 28
_PIECE = 1 << 12


def _bits(key: tuple[np.ndarray, ...], bits: int) -> Iterator[np.ndarray]:
    """Two bit numbers for each key."""
    h = np.zeros(np.broadcast_shapes(*(k.shape for k in key)), dtype=U64)
    for k in key:
        h = mix(h * U64(0x9E3779B97F4A7C15) + k.astype(np.int64).view(U64))
    yield (h >> U64(64 - bits)).astype(np.int64)
    yield (mix(h) >> U64(64 - bits)).astype(np.int64)


class BitTable:
    """Reads a table of `bit_table`."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def has(self, *key: np.ndarray) -> np.ndarray:
        """Whether the keys may be in the table: always true for one that is."""
        out = True
        for at in _bits(key, (8 * len(self.table)).bit_length() - 1):
            out = out & (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bit_table(keys: DataFrame, columns: list[str]) -> np.ndarray:
    """Bits of the hashes of the key columns (long), to leave most other rows unshuffled: false hits only, no misses.

    It has 32 bits for each key (0.4 % false hits), up to 2 ** MOST_BITS: beyond
    that it thins out fewer rows, and results stay the same.
    """
    keys = keys.select(*columns)
    bits = min(MOST_BITS, max(18, (32 * keys.count()).bit_length()))

    def mark(batches):
        table = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for b in batches:
            for at in _bits(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns), bits):
                np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        part = table.reshape(-1, _PIECE)
        keep = np.flatnonzero(part.any(axis=1))
        yield pa.record_batch({"piece": pa.array(keep.astype(np.int32)), "bits": pa.array([part[i].tobytes() for i in keep], pa.binary())})

    def either(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c, dtype=np.uint8)
                total[i] = total[i] | c if i in total else c
        yield pa.record_batch({"piece": pa.array(list(total), pa.int32()), "bits": pa.array([c.tobytes() for c in total.values()], pa.binary())})

    kind = "piece int, bits binary"
    table = np.zeros(((1 << bits) // 8 // _PIECE, _PIECE), dtype=np.uint8)
    for r in keys.mapInArrow(mark, kind).repartition("piece").mapInArrow(either, kind).collect():
        table[r["piece"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table.reshape(-1)


def may_have(keys: DataFrame, *columns: Column) -> Column:
    """Whether the long `columns`, none of them null, may be a row of `keys`: false hits only; false for nulls."""
    names = keys.columns
    shared = keys.sparkSession.sparkContext.broadcast(bit_table(keys, names))

    @F.arrow_udf("boolean")
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        cols = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in (first, second)[: len(names)]]
        return pa.array(BitTable(shared.value).has(*cols))

    return F.coalesce(F.when(~_any_null(columns), run(columns[0], columns[-1])), F.lit(False))


def _any_null(columns: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in columns])
