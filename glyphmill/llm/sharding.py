"""Operator 7: sharding by jump consistent hashing.

A stable key is hashed to 64 bits; the jump sequence of that hash decides its
shard among n without a ring table.  When shards are appended, a key either
stays or moves to one of the new shards, and the expected share that moves is
the least possible, (new - old) / new.

Defined results
---------------
* A null key hashes to 0 and is always in shard 0.  A key of several columns
  counts nulls apart from empty strings.
* Equal keys share a shard: repeated rows stay together.
* Texts of any length and nulls in other columns pass through.
* A column named like a result column is replaced; other columns stay.
* Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.common import free_names

U64 = np.uint64


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = keys.astype(U64).copy()
    out = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    nxt = np.zeros(len(key), dtype=np.int64)
    while len(live):
        out[live] = nxt
        k = key[live] * U64(2862933555777941757) + U64(1)
        key[live] = k
        nxt = ((nxt + 1) * (float(1 << 31) / ((k >> U64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go = nxt < shards
        live, nxt = live[go], nxt[go]
    return out.astype(np.int32)


def key_digest(*keys: str) -> Column:
    """Eight bytes of a digest of the key columns; null only if all are null."""
    if len(keys) == 1:
        text = F.col(f"`{keys[0]}`").cast("string")
    else:
        parts = [F.col(f"`{k}`").cast("string") for k in keys]
        text = F.when(F.coalesce(*parts).isNotNull(), F.to_json(F.array(*parts)))
    return F.substring(F.unhex(F.md5(text)), 1, 8)


def shard_of(digest: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def run(col: pa.Array) -> pa.Array:
        buf, off = textnum.string_buffers(col)
        size = np.diff(off)
        keys = np.zeros(len(col), dtype=U64)
        keys[size == 8] = np.frombuffer(buf.tobytes(), dtype=">u8")
        return pa.array(jump(keys, shards))

    return run(digest)


def assign_shards(rows: DataFrame, key: list[str], shards: int, *, appended: int = 0, gather: bool = True, split: int = 16) -> DataFrame:
    """`rows` with shard; with `appended` also shard_after and moved.

    `gather` puts the rows of a shard together, ready to write: into one of
    `split` parts each, by a hash of the whole row, so that neither a large shard
    nor the rows without a key make one large task.
    """
    made = ["shard"] + ["shard_after", "moved"] * bool(appended)
    names = [c for c in rows.columns if c not in made]
    now, after, part = free_names(rows.columns, "shard", "after", "part")
    digest = key_digest(*key)
    cols = [F.col(f"`{c}`") for c in names]
    hashable = [F.col(f"`{c}`") for c in names if "map<" not in rows.schema[c].dataType.simpleString()]
    out = rows.select(
        *cols, shard_of(digest, shards).alias(now), *([shard_of(digest, shards + appended).alias(after)] if appended else []),
        *([F.pmod(F.xxhash64(*hashable), F.lit(split)).alias(part)] if gather else []),
    )
    if gather:
        out = out.repartition(now, part)
    return out.select(*cols, F.col(now).alias("shard"), *(
        [F.col(after).alias("shard_after"), (F.col(now) != F.col(after)).alias("moved")] if appended else []
    ))
