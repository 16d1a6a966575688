"""Operator 5: repeated passages by a logarithmic family of suffix arrays.

Documents are word sequences.  Every window of `min_words` words has an anchor,
the least of the hashed word runs (`ANCHOR` words) inside it, so equal windows
have equal anchors.  Runs of windows with one anchor are segments; a segment
whose anchor occurs once in the corpus can't repeat.  The other segments are
partitioned by anchor, in the order of documents, and each partition keeps a
family of suffix arrays:

* a new batch of segments gets a suffix array of its window starts, sorted by
  prefix doubling over the first `min_words` words; of equal suffixes the
  earliest stays, the others are repeats;
* it is merge-scanned against every existing level: the place of each of its
  suffixes is found in the level's order, which shows the repeats;
* its new suffixes become level 0, and while two levels have about the same size
  they are merged, so a partition of n suffixes has log2(n) levels and a suffix
  is merged at most as often.

The repeated windows of a document are joined to maximal spans.

Defined results
---------------
* Words are runs of letters and digits; case is folded for ASCII and Latin-1.
  Passages of `min_words` words or more that occur earlier, in the same or
  another document, are reported; what comes first, by doc_id and position, isn't.
* Rows whose doc_id or text is null take no part.  Texts shorter than
  `min_words` words have no windows.
* Rows that share a doc_id are read in the order of a hash of their text, as
  documents of their own; fully repeated rows are one document.
* Ties: the earliest occurrence of a window is its source.
* Very long texts are cut into segments like all others; further columns aren't
  read.  Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.common import Workspace
from glyphmill.llm.line_dedup import fold

U64 = np.uint64
ANCHOR = 8
SLICE = 1 << 18
BATCH_SUFFIXES = 1 << 16


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value (the last of equals) in each window of w values."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(h))
    size = 1
    while size * 2 <= w:
        a, b = best[:-size], best[size:]
        best = np.where(h[b] <= h[a], b, a)
        size *= 2
    if size < w:
        a, b = best[:n], best[w - size : w - size + n]
        best = np.where(h[b] <= h[a], b, a)
    return best[:n]


def segments(buf: np.ndarray, off: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Segments of all rows: row, anchor hash, first window, number of windows; and word hashes, first word of each row, word starts and ends."""
    low = fold(buf)
    s, e, row = textnum.word_spans(low, off)
    h = textnum.span_hashes(low, s, e) if len(s) else np.empty(0, U64)
    first = np.searchsorted(row, np.arange(len(off)))
    grams = textnum.gram_hashes(h, ANCHOR)
    windows = len(h) - min_words + 1
    empty = np.empty(0, np.int64)
    if windows <= 0:
        return empty, np.empty(0, U64), empty, empty, h, first, s, e
    least = sliding_least(grams, min_words - ANCHOR + 1)[:windows]
    whole = row[:windows] == row[min_words - 1 : min_words - 1 + windows]
    at = np.flatnonzero(whole)
    if not len(at):
        return empty, np.empty(0, U64), empty, empty, h, first, s, e
    a = least[at]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
    lead = np.flatnonzero(new)
    return row[at[lead]], grams[a[lead]], at[lead], np.diff(np.append(lead, len(at))), h, first, s, e


def short_words(h: np.ndarray) -> np.ndarray:
    return (h >> U64(32)).astype(np.uint32)


def rank_windows(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length` words at each start, equal for equal runs; by prefix doubling.  `words` is padded by `length` zeros."""
    size = 1
    rank = words.astype(U64)
    need = starts
    # positions whose rank is wanted at each doubling: all, since starts lie densely in their segments
    while size * 2 <= length:
        pair = (rank[:-size] << U64(32)) | rank[size:]
        _, inverse = np.unique(pair, return_inverse=True)
        rank = np.concatenate([inverse.astype(U64), np.zeros(size, dtype=U64)])
        size *= 2
    pair = (rank[need] << U64(32)) | rank[need + (length - size)]
    return np.unique(pair, return_inverse=True)[1]


class Level:
    """A suffix array: window starts in the lexicographic order of their words, and where each came from."""

    def __init__(self, words: np.ndarray, order: np.ndarray, origin: np.ndarray):
        self.words, self.order, self.origin = words, order, origin
        self.lead = self.pairs(order, 0)

    def pairs(self, at: np.ndarray, depth: int) -> np.ndarray:
        w = self.words
        return (w[at + depth].astype(U64) << U64(32)) | w[at + depth + 1]

    def __len__(self) -> int:
        return len(self.order)

    def place(self, words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of `words` at `at`: its place in this order, and whether it is there."""
        def pair(i: np.ndarray, depth: int) -> np.ndarray:
            return (words[at[i] + depth].astype(U64) << U64(32)) | words[at[i] + depth + 1]

        every = np.arange(len(at))
        key = pair(every, 0)
        lo = np.searchsorted(self.lead, key, side="left")
        hi = np.searchsorted(self.lead, key, side="right")
        live = every[lo < hi]
        depth = 2
        while depth < length and len(live):
            d = min(depth, length - 2)
            key = pair(live, d)
            lo[live], hi[live] = self._narrow(lo[live], hi[live], key, d)
            live = live[lo[live] < hi[live]]
            depth += 2
        return lo, lo < hi

    def _narrow(self, lo: np.ndarray, hi: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows in [lo, hi) whose two words at `depth` are `key`, by one vectorised bisection for each end."""
        ends = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while (go := np.flatnonzero(a < b)).size:
                mid = (a[go] + b[go]) >> 1
                v = self.pairs(self.order[mid], depth)
                less = v <= key[go] if right else v < key[go]
                a[go[less]] = mid[less] + 1
                b[go[~less]] = mid[~less]
            ends.append(a)
        return ends[0], ends[1]

    def merge(self, other: Level, length: int) -> Level:
        """One level with the suffixes of both; they have none in common."""
        at, _ = self.place(other.words, other.order, length)
        words = np.concatenate([self.words, other.words])
        order = np.insert(self.order, at, other.order + len(self.words))
        return Level(words, order, np.insert(self.origin, at, other.origin, axis=0))


class Family:
    """Levels of suffix arrays whose sizes grow geometrically."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, words: np.ndarray, starts: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds a batch of windows in order; returns which are repeats and the origin of the first occurrence."""
        rank = rank_windows(words, starts, self.length)
        order = np.argsort(rank, kind="stable")
        new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
        lead = np.flatnonzero(new)
        first = order[lead][np.cumsum(new) - 1]  # the earliest window equal to each, in suffix order
        source = np.empty_like(origin)
        source[order] = origin[first]
        repeat = np.ones(len(starts), dtype=bool)
        repeat[order[lead]] = False
        mine = order[lead]
        found = np.zeros(len(mine), dtype=bool)
        base = np.empty((len(mine), origin.shape[1]), dtype=origin.dtype)
        for level in self.levels:
            place, hit = level.place(words, starts[mine], self.length)
            base[hit] = level.origin[place[hit]]
            found |= hit
        group = np.cumsum(new) - 1
        known = found[group]
        repeat[order[known]] = True
        source[order[known]] = base[group[known]]
        fresh = mine[~found]
        if len(fresh):
            self._insert(Level(words, starts[fresh], origin[fresh]))
        return repeat, source

    def _insert(self, level: Level) -> None:
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self.levels.pop().merge(level, self.length)
        self.levels.append(level)


_SPAN = "doc long, text_hash int, first int, windows int, source_doc long, source_hash int, source int"


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = textnum.string_buffers(batch.column(2))
            for lo, hi in textnum.slices(off, SLICE):
                row, anchor, *_ = segments(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], min_words)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64))], names=["doc", "text_hash", "anchor"]
                )

    return run


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of whole anchors, the rows whose anchor occurs again."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    anchor = t["anchor"].to_numpy()
    order = np.argsort(anchor, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    count = np.diff(np.append(new, len(order)))
    yield from t.take(pa.array(np.sort(order[np.repeat(count > 1, count)]))).combine_chunks().to_batches(max_chunksize=50000)


def _cut(min_words: int):
    """Segments of the wanted anchors: (doc, text_hash, text, anchors) to rows with the segment's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                buf, off = textnum.string_buffers(batch.column(2))
                row, anchor, first, many, h, base, *_ = segments(buf, off, min_words)
                lists = batch.column(3)
                owner = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).to_numpy())
                wanted = lists.flatten().to_numpy().view(U64)
                have = np.isin(textnum.mix(anchor ^ row.astype(U64)), textnum.mix(wanted ^ owner.astype(U64)))
                row, anchor, first, many = row[have], anchor[have], first[have], many[have]
                if not len(row):
                    continue
                size = many + min_words - 1
                words = short_words(h)
                flat = words[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                ends = np.concatenate([[0], np.cumsum(size) * 4]).astype(np.int32)
                col = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                        pa.array((first - base[row]).astype(np.int32)), col,
                    ],
                    names=["anchor", "doc", "text_hash", "first", "words"],
                )

    return run


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family(min_words)
        for whole in batches:
            raw, off = textnum.string_buffers(whole.column(4))
            origin = [whole.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)]
            windows = np.diff(off) // 4 - (min_words - 1)
            for lo, hi in textnum.slices(np.concatenate([[0], np.cumsum(windows)]), BATCH_SUFFIXES):
                words = raw[off[lo] : off[hi]].view(np.uint32)
                words = np.concatenate([words, np.zeros(min_words + 2, np.uint32)])
                many = windows[lo:hi]
                inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                starts = np.repeat((off[lo:hi] - off[lo]) // 4, many) + inside
                where = np.stack([np.repeat(o[lo:hi], many) for o in origin], axis=1)
                where[:, 2] += inside
                repeat, source = family.add(words, starts, where)
                at = np.flatnonzero(repeat)
                if not len(at):
                    continue
                a, b = where[at], source[at]
                step = np.concatenate([[True], (np.diff(a[:, 2]) != 1) | (a[1:, :2] != a[:-1, :2]).any(axis=1) | (b[1:, :2] != b[:-1, :2]).any(axis=1) | (np.diff(b[:, 2]) != 1)])
                lead = np.flatnonzero(step)
                yield pa.record_batch(
                    {
                        "doc": a[lead, 0], "text_hash": a[lead, 1].astype(np.int32), "first": a[lead, 2].astype(np.int32),
                        "windows": np.diff(np.append(lead, len(at))).astype(np.int32), "source_doc": b[lead, 0],
                        "source_hash": b[lead, 1].astype(np.int32), "source": b[lead, 2].astype(np.int32),
                    }
                )

    return run


def repeated_passages(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """(doc_id, first_word, last_word, source_doc_id, source_word) of the passages that occurred before.

    Spans of one document are maximal runs of repeated windows with the same
    source document and offset; words are counted from 0 and last_word is included.
    """
    if min_words < 2 * ANCHOR:
        raise ValueError(f"min_words must be at least {2 * ANCHOR}")
    ws = Workspace(docs.sparkSession, "suffix-dedup")
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.hash(text).alias("text_hash"), text.alias("text")).where(
        "doc is not null and text is not null"
    )
    wanted = (
        base.mapInArrow(_anchors(min_words), "doc long, text_hash int, anchor long").repartition("anchor")
        .mapInArrow(_repeated_anchors, "doc long, text_hash int, anchor long")
    )
    lists = ws.save(wanted.groupBy("doc", "text_hash").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    cut = base.join(lists, ["doc", "text_hash"]).select("doc", "text_hash", "text", "anchors").mapInArrow(_cut(min_words), "anchor long, doc long, text_hash int, first int, words binary")
    found = (
        cut.repartition("anchor").sortWithinPartitions("doc", "text_hash", "first")
        .mapInArrow(_scan(min_words), _SPAN)
        .where("doc <> source_doc or text_hash <> source_hash or first <> source")
    )
    spans = ws.save(found, "spans")
    ws.drop(lists)
    shift = F.col("source") - F.col("first")
    key = ["doc", "text_hash", "source_doc", "source_hash", "shift"]
    ordered = spans.withColumn("shift", shift).withColumn("stop", F.col("first") + F.col("windows"))
    over = "over (partition by doc, text_hash, source_doc, source_hash, shift order by first"
    runs = ordered.withColumn("reach", F.expr(f"max(stop) {over} rows between unbounded preceding and 1 preceding)")).withColumn(
        "part", F.expr(f"sum(if(reach is null or first > reach, 1, 0)) {over} rows between unbounded preceding and current row)")
    )
    return runs.groupBy(*key, "part").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).select(
        F.col("doc").alias("doc_id"), F.col("first").alias("first_word"), (F.col("stop") + (min_words - 2)).alias("last_word"),
        F.col("source_doc").alias("source_doc_id"), (F.col("first") + F.col("shift")).alias("source_word"),
    ).distinct()
