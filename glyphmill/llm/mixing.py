"""Operator 10: mixing sources to target weights.

1. Pack: texts are encoded with a tokenizer's vocabulary, and the tokens of a
   source, in the order in which its rows are read, are cut into blocks of a
   fixed number of tokens; a block may hold the end of one document and the
   start of the next.  Every row knows where its tokens begin by the running
   count within its task and the count of the source's tasks before it, so that
   only the last block of a source is short, whatever the size of the corpus.
2. Draw: every output shard draws its source counts from a multinomial
   distribution over the target weights, seeded by the shard's number.
3. Map: the slots of a source are numbered over all shards.  Slot j takes the
   block at position j mod n of a pseudorandom permutation of the source's n
   blocks, another permutation for every n slots.  The permutation is a Feistel
   network with cycle walking, so it needs no table and no sort.
4. Join the blocks by index.

So a source above its share is sampled without repeats, and one below it
repeats all its blocks equally often, up to one.

Defined results
---------------
* Rows whose text is null or empty hold no tokens and give no blocks.
* A null source is a source of its own; a null doc_id stays null in the result.
* Repeated rows are packed as often as they occur.
* Given weights must name the sources that have tokens, all of them (0 leaves a
  source out) and no others; anything else, and more than MOST_SOURCES sources,
  is an error.
* Texts of any length are packed whole.  Where `mix_documents` cuts a text inside
  a character, that character goes to the later piece.
* Further columns are ignored by `mix_blocks`; `mix_documents` returns them
  with each piece, whatever their names.
* Empty table, or no tokens at all: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import textnum
from glyphmill.llm.bpe import PATTERN, VOCABULARY, broadcast_vocabulary, codec, compiled
from glyphmill.llm.common import Workspace, bounded, trim

U64 = np.uint64
#: Weights are kept in an array on the driver and in each task.
MOST_SOURCES = 1 << 16
BATCH_BYTES = 4 << 20
#: Rows of the table of offsets, of some 40 bytes each, that are broadcast.
MOST_BROADCAST_ROWS = 500_000


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under the pseudorandom permutation of [0, n) that `key` names."""
    index, n, key = (np.asarray(x).astype(U64) for x in (index, n, key))
    half = np.ones(len(n), dtype=U64)  # bits of each half, so that 2 ** (2 * half) >= n
    while (small := (U64(1) << (half * U64(2))) < n).any():
        half[small] += U64(1)
    mask = (U64(1) << half) - U64(1)
    out = index.copy()
    live = np.arange(len(out))
    while len(live):
        h, m, k = half[live], mask[live], key[live]
        left, right = out[live] >> h, out[live] & m
        for r in range(4):
            f = textnum.mix(right + textnum.mix(k + U64(r * 0x9E3779B9 + 1))) & m
            left, right = right, left ^ f
        out[live] = (left << h) | right
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def draw_counts(shard: int, size: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """Multinomial source counts of one output shard."""
    return np.random.default_rng([seed, shard]).multinomial(size, weights)


def target_weights(tokens: dict[str | None, int], weights: dict[str | None, float] | None, temperature: float) -> dict[str | None, float]:
    """Shares of the sources that have tokens: the given weights, or token counts to the power 1 / temperature."""
    have = {s: n for s, n in tokens.items() if n}
    if weights is not None and have and set(weights) != set(have):
        raise ValueError(f"weights and sources differ in {sorted(map(str, set(weights) ^ set(have)))[:20]}")
    raw = {s: float(n) ** (1 / temperature) if weights is None else float(weights[s]) for s, n in have.items()}
    if any(not w >= 0 for w in raw.values()):
        raise ValueError("weights must be numbers that aren't negative")
    total = sum(raw.values())
    if raw and total <= 0:
        raise ValueError("no source with tokens has a positive weight")
    return {s: w / total for s, w in raw.items()}


def _encode(shared, pattern: str):
    """Rows (source, doc, text, ...) to (source, doc, task, first token in the task's tokens of the source, tokens, packed ids, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = compiled(shared.value, pattern), id_type(shared.value)
        task, so_far = TaskContext.get().partitionId(), {}
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in bounded(batches, 2):
            first, many, packed, keep = [], [], [], []
            for i, (source, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                text = text.as_py()
                if not text:
                    continue
                ids = encoder(text)
                keep.append(i)
                first.append(so_far.get(source, 0))
                many.append(len(ids))
                packed.append(pack(ids.astype(kind).tobytes()))
                so_far[source] = first[-1] + len(ids)
            rows = batch.take(pa.array(keep, pa.int64()))
            cols = [rows.column(0), rows.column(1), pa.array(np.full(len(keep), task, np.int32)), pa.array(first, pa.int64()), pa.array(many, pa.int64()), pa.array(packed, pa.binary())]
            extra = rows.schema.names[3:]
            yield pa.RecordBatch.from_arrays([*cols, *rows.columns[3:]], names=["source", "doc", "task", "first", "n", "ids", *extra])
        trim()

    return run


def id_type(raw: bytes) -> type:
    """The narrowest type for the ids of a vocabulary with fewer than `raw` has lines."""
    return np.uint16 if raw.count(b"\n") < 1 << 16 and max(int(x.rpartition(b" ")[2]) for x in raw.splitlines() if x) < 1 << 16 else np.uint32


def block_cuts(offset: int, n: int, block_tokens: int) -> np.ndarray:
    """Token numbers of a document at which its pieces begin, and its end; `offset` tokens of the source come before."""
    inner = np.arange(-(-(offset + 1) // block_tokens) * block_tokens, offset + n, block_tokens) - offset
    return np.concatenate([[0], inner, [n]]).astype(np.int64)


def text_cuts(ids: np.ndarray, cuts: np.ndarray, vocabulary: list[bytes], lengths: np.ndarray) -> list[bytes]:
    """The bytes of each piece, with cuts moved back to the start of a character."""
    raw = b"".join(map(vocabulary.__getitem__, ids.tolist()))
    at = np.concatenate([[0], np.cumsum(lengths[ids])])[cuts].tolist()
    for i, p in enumerate(at[1:-1], 1):
        while raw[p] & 0xC0 == 0x80:
            p -= 1
        at[i] = p
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _pieces(shared, pattern: str, block_tokens: int, texts: bool):
    """Rows (source_no, base, first, n, ids, ...) to (source_no, index, begin, tokens, ids or text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, c = id_type(shared.value), codec(shared.value, pattern) if texts else None
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            extra = batch.schema.names[5:]
            rows, size = [], 0

            def made() -> pa.RecordBatch:
                at, index, begin, many, body = zip(*rows)
                take = pa.array(at, pa.int64())
                body = pa.array([b.decode() for b in body], pa.string()) if texts else pa.array(body, pa.binary())
                cols = [batch.column(0).take(take), pa.array(index, pa.int64()), pa.array(begin, pa.int32()), pa.array(many, pa.int32()), body]
                return pa.RecordBatch.from_arrays([*cols, *(x.take(take) for x in batch.columns[5:])], names=["source_no", "index", "begin", "n", "body", *extra])

            for i, (base, first, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in (1, 2, 3)))):
                ids = np.frombuffer(unpack(batch.column(4)[i].as_py()), kind)
                cuts = block_cuts(base + first, n, block_tokens)
                place = base + first + cuts
                bodies = text_cuts(ids, cuts, c.vocabulary, c.lengths) if texts else [pack(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
                for p, m, body in zip(place.tolist(), np.diff(cuts).tolist(), bodies):
                    if body:
                        rows.append((i, p // block_tokens, p % block_tokens, m, body))
                        size += len(body)
                    if size > BATCH_BYTES:
                        yield made()
                        rows, size = [], 0
            if rows:
                yield made()
        trim()

    return run


def _assemble(kind: type, names: list[str | None]):
    """Whole blocks from their pieces: rows (shard, place, source_no, epoch, index, begin, n, ids, doc), sorted."""

    def block(rows: list[tuple]) -> tuple:
        unpack = zstandard.ZstdDecompressor().decompress
        shard, place, source, epoch, index, *_ = rows[0]
        ids = np.frombuffer(b"".join(unpack(r[7]) for r in rows), kind).astype(np.int32)
        return shard, place, names[source], epoch, index, [r[8] for r in rows], len(ids), ids

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*out), kinds)], names=_BLOCK_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = [], []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if rows and rows[-1][:2] != r[:2]:
                    out.append(block(rows))
                    rows = []
                rows.append(r)
                if len(out) >= 500:
                    yield made(out)
                    out = []
        if rows:
            out.append(block(rows))
        if out:
            yield made(out)

    return run


_BLOCK = "shard long, place int, source string, epoch int, index long, doc_ids array<bigint>, n_tokens int, token_ids array<int>"
_BLOCK_NAMES = ["shard", "place", "source", "epoch", "index", "doc_ids", "n_tokens", "token_ids"]


def _draw(shard_blocks: int, total: int, weights: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(weights)
        for batch in batches:
            shards = batch.column(0).to_numpy()
            counts = [draw_counts(int(s), int(min(shard_blocks, total - s * shard_blocks)), weights, seed) for s in shards]
            counts = np.array(counts, dtype=np.int64).reshape(-1, k)
            yield pa.record_batch(
                {
                    "shard": np.repeat(shards, k), "source_no": np.tile(np.arange(k, dtype=np.int32), len(shards)),
                    "count": counts.reshape(-1), "offset": (np.cumsum(counts, axis=1) - counts).reshape(-1),
                }
            )

    return run


def _indexes(shard_blocks: int, total: int, blocks: np.ndarray, seed: int):
    """Slots to block indexes; and slots to places in their shard, so that sources alternate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, j, slot = (batch.column(i).to_numpy() for i in range(4))
            n = blocks[source]
            epoch = j // n
            key = textnum.mix(source.astype(U64) * U64(0x9E3779B97F4A7C15) + epoch.astype(U64) + U64(seed << 20))
            size = np.minimum(shard_blocks, total - shard * shard_blocks)
            place = permute(slot, size, textnum.mix(shard.astype(U64) + U64(seed * 2 + 1)))
            yield pa.record_batch(
                {
                    "shard": shard, "place": place.astype(np.int32), "source_no": source, "epoch": epoch.astype(np.int32),
                    "index": permute(j % n, n, key),
                }
            )

    return run


def _mix(
    docs: DataFrame, extra: list[str], texts: bool, *, weights: dict | None = None, temperature: float = 2.0,
    block_tokens: int = 1024, shard_blocks: int = 4096, total_blocks: int | None = None, seed: int = 7,
    vocabulary: str = VOCABULARY, pattern: str = PATTERN,
) -> tuple[DataFrame, list[str | None], type]:
    """(pieces with the slots that they fill, names of the sources by number, type of the ids)."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    shared = broadcast_vocabulary(spark, vocabulary)
    source = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(f"e{j}") for j, c in enumerate(extra)],
    )
    fields = T._parse_datatype_string("source string, doc long, task int, first long, n long, ids binary").fields
    encoded = ws.save(source.mapInArrow(_encode(shared, pattern), T.StructType([*fields, *source.schema.fields[3:]])), "encoded")
    tasks = ws.save(encoded.groupBy("source", "task").agg(F.sum("n").alias("tokens")), "tasks")
    totals = tasks.groupBy("source").agg(F.sum("tokens").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = {r["source"]: r["n"] for r in totals}
    share = target_weights(tokens, weights, temperature)
    names = sorted(share, key=lambda s: (s is not None, s or ""))
    blocks = np.array([-(-tokens[s] // block_tokens) for s in names], dtype=np.int64)
    total = int(blocks.sum()) if total_blocks is None else total_blocks
    shards = -(-total // shard_blocks) if names else 0

    drawn = spark.range(shards).select("id").mapInArrow(
        _draw(shard_blocks, total, np.array([share[s] for s in names]), seed), "shard long, source_no int, count long, offset long"
    )
    before = "coalesce(sum({}) over (partition by source_no order by {} rows between unbounded preceding and 1 preceding), 0)"
    slots = (
        drawn.withColumn("base", F.expr(before.format("count", "shard"))).where("count > 0")
        .select("shard", "source_no", "base", "offset", F.explode(F.expr("sequence(0L, count - 1)")).alias("k"))
        .select("shard", "source_no", F.expr("base + k").alias("j"), F.expr("offset + k").alias("slot"))
        .mapInArrow(_indexes(shard_blocks, total, blocks, seed), "shard long, place int, source_no int, epoch int, index long")
    )
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "name string, source_no int")
    bases = tasks.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("name"))).select(
        "source_no", F.col("source").alias("of"), F.col("task").alias("in"), F.expr(before.format("tokens", "task")).alias("base")
    )
    # a row for each source of each task, beside the texts of that task; beyond the bound, texts are shuffled to them
    if tasks.count() <= MOST_BROADCAST_ROWS:
        bases = F.broadcast(bases)
    placed = encoded.join(bases, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in")))
    kept = [f"e{j}" for j in range(len(extra))] if texts else ["doc"]
    placed = placed.select("source_no", "base", "first", "n", "ids", *kept)
    kind = T.StructType([*T._parse_datatype_string(f"source_no int, index long, begin int, n int, body {'string' if texts else 'binary'}").fields, *placed.schema.fields[5:]])
    pieces = placed.mapInArrow(_pieces(shared, pattern, block_tokens, texts), kind)
    return pieces.join(slots.hint("shuffle_hash"), ["source_no", "index"]), names, id_type(shared.value)


def mix_blocks(docs: DataFrame, **options) -> DataFrame:
    """(shard, place, source, epoch, index, doc_ids, n_tokens, token_ids) of the drawn blocks, shard by shard in order of place.

    doc_ids has the document of each piece of the block.  Options: weights (by
    source; without them, token counts to the power 1 / temperature),
    temperature, block_tokens, shard_blocks, total_blocks (as many as there are
    blocks, if not given), seed, vocabulary, pattern.
    """
    pieces, names, kind = _mix(docs, [], False, **options)
    return (
        pieces.repartition("shard").sortWithinPartitions("shard", "place", "begin")
        .select("shard", "place", "source_no", "epoch", "index", "begin", "n", "body", "doc").mapInArrow(_assemble(kind, names), _BLOCK)
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The drawn blocks as rows of `docs`: one row for each piece of a document in a drawn block.

    All columns stay; text is the piece and n_chars, if there, its length.
    """
    extra = [c for c in docs.columns if c != "text"]
    out, _, _ = _mix(docs, extra, True, **options)
    cols = {c: F.col(f"e{j}") for j, c in enumerate(extra)} | {"text": F.col("body")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("body").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])
