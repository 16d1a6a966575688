"""Operator 2: byte-pair encoding and decoding.

A text is cut into pieces by the tokenizer's pattern.  A piece that isn't a
token itself starts as single bytes on a doubly linked list; a priority queue
holds the merge ranks of neighbouring pairs, the least rank merges first (ties:
the leftmost), and entries whose symbols have changed since are stale and
skipped.  Decoding concatenates vocabulary strings.

A vocabulary is a rank file: base64 bytes and rank on each line.  The driver
reads it and broadcasts it (its size doesn't depend on the data).

Defined results
---------------
* Null text: null token_ids, n_tokens and round_trip.  Empty text: an empty
  list, 0 and true.
* Texts of any length are encoded whole; decoding restores them byte by byte.
* Repeated rows are encoded row by row; the order of rows doesn't matter.
* Null in any other column passes through; further columns pass through as
  they are, but a column named like a result column is replaced by the result.
* Empty table: no rows, the same schema.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.common import bound_batches, bounded

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies cut text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a Python worker remembers; memory only, never a result.
REMEMBERED = 600_000
ROWS_OUT = 1000


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    width = n + 1
    after = list(range(1, n + 1))  # start of the next symbol, which is this one's end; 0 for a dead symbol
    before = list(range(-1, n - 1))
    get = ranks.get
    queue = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            queue.append((r * width + i) * width + i + 2)
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    while queue:
        key, end = divmod(pop(queue), width)
        i = key % width
        mid = after[i]
        if not mid or mid == n or after[mid] != end:
            continue  # stale: one of the two symbols has merged since
        after[mid] = 0
        after[i] = end
        if end < n:
            before[end] = i
            far = after[end]
            r = get(piece[i:far])
            if r is not None:
                push(queue, (r * width + i) * width + far)
        left = before[i]
        if left >= 0:
            r = get(piece[left:end])
            if r is not None:
                push(queue, (r * width + left) * width + end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Remembered(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(merge(piece.encode(), self.ranks), dtype=np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary in one Python worker."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.ranks = parse_ranks(raw)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.vocabulary: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.array([len(t) for t in self.vocabulary], dtype=np.int64)
        self.pieces = regex.compile(pattern).findall
        self.known = _Remembered(self.ranks)

    def encode_bytes(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of `ids`; an id that the vocabulary doesn't have, or null, raises an error."""
        try:
            return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")
        except KeyError as e:
            raise ValueError(f"the vocabulary has no token {e.args[0]}") from None

    def encode_column(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all rows, row offsets)."""
        raw = [b"" if t is None else self.encode_bytes(t) for t in texts]
        off = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum([len(r) // 4 for r in raw], out=off[1:])
        return np.frombuffer(b"".join(raw), dtype=np.int32), off


_codecs: dict[tuple[int, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of this Python worker, kept between tasks."""
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


_compiled: dict[tuple[int, str], Callable[[str], np.ndarray]] = {}


def compiled(raw: bytes, pattern: str) -> Callable[[str], np.ndarray]:
    """The token ids that `Codec` gives, by a compiled library: for operators that count or cut tokens."""
    key = (hash(raw), pattern)
    if key not in _compiled:
        _compiled.clear()
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})
        _compiled[key] = partial(encoding.encode_to_numpy, disallowed_special=())
    return _compiled[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def broadcast_vocabulary(spark: SparkSession, path: str):
    bound_batches(spark)
    return spark.sparkContext.broadcast(read_vocabulary(path))


def _list_array(ids: np.ndarray, off: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(off.astype(np.int32), pa.int32(), mask=None if mask is None or not mask.any() else np.append(mask, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN,
    keep: list[str] | None = None, verify: bool = False,
) -> DataFrame:
    """`docs` with token_ids and n_tokens; with `verify` also round_trip, whether decoding gives back the text.

    `keep` names the further columns of the result (all but the text by default).
    """
    made = ["token_ids", "n_tokens"] + ["round_trip"] * verify
    names = [c for c in (docs.columns if keep is None else keep) if c != text and c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").cast("string").alias("__gm_text"))
    schema = T.StructType(
        [source.schema[c] for c in names]
        + [T.StructField("token_ids", T.ArrayType(T.IntegerType(), True)), T.StructField("n_tokens", T.IntegerType())]
        + [T.StructField("round_trip", T.BooleanType())] * verify
    )
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for whole in bounded(batches, len(names)):
            for lo in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(lo, ROWS_OUT)
                texts = batch.column(len(names)).to_pylist()
                ids, off = c.encode_column(texts)
                null = np.array([t is None for t in texts], dtype=bool)
                cols = [batch.column(i) for i in range(len(names))]
                cols += [_list_array(ids, off, null), pa.array(np.diff(off).astype(np.int32), pa.int32(), mask=null)]
                if verify:
                    same = [
                        t is not None and c.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, off[:-1], off[1:])
                    ]
                    cols.append(pa.array(np.array(same, dtype=bool), pa.bool_(), mask=null))
                yield pa.RecordBatch.from_arrays(cols, names=names + made)

    return source.mapInArrow(run, schema)


def decode(
    encoded: DataFrame, *, ids: str = "token_ids", vocabulary: str = VOCABULARY, text: str = "text"
) -> DataFrame:
    """`encoded` with its token ids replaced by the decoded text; a null list gives a null text.

    Ids outside the vocabulary, and nulls within a list, raise an error; bytes that aren't UTF-8, as in a
    list cut inside a character, become replacement characters.
    """
    names = [c for c in encoded.columns if c not in (ids, text)]
    source = encoded.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").cast("array<int>").alias("__gm_ids"))
    schema = T.StructType([source.schema[c] for c in names] + [T.StructField(text, T.StringType())])
    shared = broadcast_vocabulary(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, PATTERN)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(lo, ROWS_OUT)
                out = [None if x is None else c.decode(x) for x in batch.column(len(names)).to_pylist()]
                cols = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], names=[*names, text])

    return source.mapInArrow(run, schema)
