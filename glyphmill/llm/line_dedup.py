"""Operator 8: line dedup by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity (their counts over
all lines of all documents, hashed into a table of fixed size; ties by hash, so
the order is total and the same everywhere).  Two lines can only reach the
Jaccard threshold if they share a word among the first size - ceil(t * size) + 1
of each (prefix filter), if their sizes agree (length filter) and if the shared
word's places leave room for enough others (positional filter).  A parity map
of each set, whose size follows the set's, bounds the overlap from above and
drops most chance candidates too; none of the filters loses a match.  A line
goes if any earlier line, by doc_id and position, matches it, whether that one
stays or not.

1. Repeats: lines with the same set, told by the set's size, its rarest word and
   a 128-bit digest of its words, are found in the batch of documents and then
   in the group of their rarest word.  Only the first of them joins.
2. In the group of each prefix word, every line keeps its closest earlier
   candidate, and the candidates are joined to components: pairs inside one
   aren't looked at again once a line has `MOST`.  The closest of all groups is
   verified on the whole sets.
3. The components of all groups that share lines are one.  Where a line has no
   match yet and had other candidates, it meets all earlier lines of its
   component, whole sets in hand, each of which travels there once.
4. Groups above `HOT` lines aren't gathered into one task: they are cut into
   blocks, and all pairs of blocks are compared; so are components above it.

So the result is exact, no row is shuffled for each pair of near-copies, and
what is shuffled follows the number of words.

Defined results
---------------
* Words are runs of letters and digits; case is folded for ASCII and Latin-1.
  They are compared by 64-bit hashes.
* Lines of fewer than `min_tokens` distinct words (3 by default) are removed
  only if they have `min_bytes` bytes (64) or more: blank lines, separators, one
  or two words repeat by chance, a long line in an unspaced script doesn't.
* Rows whose doc_id or text is null are returned as they are and take no part.
* Rows that share a doc_id and differ in text are different documents, ordered
  by a 32-bit hash of the text; rows that agree in both have the same result.
* A text that loses all its lines becomes the empty text; an empty text stays.
* Further columns pass through untouched, whatever their names; one named like
  `count` is replaced by it.
* Empty table: no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.common import BitTable, Workspace, bit_table, connected_components, free_names, group_bounds, grouped, may_have, trim

U64 = np.uint64
CELLS = 1 << 20  # of the hashed word counts: 1 MB of classes, whatever the data
PIECE = 1 << 10  # cells that travel in one row
SLICE = 1 << 18
MAX_LINES = 4096  # 12 bits beside 8 of rarity and 44 of hash
ONCE = 8  # the rarity class of a word that occurs once
PACK = 1 << 18  # postings that a task gathers before it sends them
PART_BYTES = 16 << 20  # of postings in a partition
HOLD = 1 << 20  # postings of a partition before repeats are dropped from memory
HOT = 1 << 15  # lines of a group that are compared in one task
CHUNK = 1 << 16  # postings that are worked on at once; a larger group stands alone
MOST = 16  # candidates of a line among which a group looks for the closest
GONE = 0xFFFFFFFF  # place of a posting that stands for a line removed already

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: A line: its document, and the hash of the text above the line's number.
LINE = ["doc", "at"]
X, Y = ["x_doc", "x_at"], ["y_doc", "y_at"]


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower-cases ASCII and Latin-1 letters of UTF-8 bytes."""
    out = _FOLD[buf]
    if len(out) > 1:
        after = out[1:]
        up = (buf[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        after[up] += 0x20
    return out


def line_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row of each line, its number in its row, its bytes; line of each word, hash of each word)."""
    low = fold(buf)
    cut = np.flatnonzero(low == 10) + 1
    starts = np.concatenate([off[:-1], cut])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, cut - 1, side="right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    s, e, _ = textnum.word_spans(low, off)
    line = np.searchsorted(starts, s, side="right") - 1
    return row, number, np.diff(np.append(starts, len(buf))), line, textnum.span_hashes(low, s, e)


def ordered_sets(line: np.ndarray, h: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, word, rarity class) without repeats, each line's words from rare to frequent."""
    key = (line.astype(U64) << U64(52)) | (rarity[h >> U64(44)].astype(U64) << U64(44)) | (h >> U64(20))
    order = np.argsort(key)
    k, w = key[order], h[order]
    if ((k[1:] == k[:-1]) & (w[1:] != w[:-1])).any():
        order = np.lexsort((h, key))
        k, w = key[order], h[order]
    if len(k):
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
        k, w = k[new], w[new]
    return (k >> U64(52)).astype(np.int64), w, (k >> U64(44)).astype(np.uint8)


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 logarithmic steps, rare first."""
    return np.minimum(255, np.rint(8 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def _pieces(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges small enough for a slice and, but for single rows, for the line bits."""
    newlines = np.concatenate([[0], np.cumsum(buf == 10)])
    for lo, hi in textnum.slices(off, SLICE):
        if hi - lo + newlines[off[hi]] - newlines[off[lo]] <= MAX_LINES:
            yield lo, hi
        else:
            for r in range(lo, hi):
                yield r, r + 1


def line_sets(batch: pa.RecordBatch, rarity: np.ndarray, least: tuple[int, int], wanted=None) -> Iterator[tuple[np.ndarray, ...]]:
    """Lines that take part, per piece of a (doc, text_hash, text) batch: doc, at, first word and size of each set; words, classes.

    With `wanted`, only lines with a word that it picks.
    """
    docs = batch.column(0).to_numpy(zero_copy_only=False)
    hashes = batch.column(1).to_numpy(zero_copy_only=False)
    buf, off = textnum.string_buffers(batch.column(2))
    for lo, hi in _pieces(buf, off):
        row, number, size_bytes, line, h = line_words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        if wanted is not None:
            keep = np.zeros(len(row), dtype=bool)
            keep[line[wanted(h)]] = True
            keep = keep[line]
            line, h = line[keep], h[keep]
        for base in range(0, len(row), MAX_LINES):  # a row with very many lines
            a, b = np.searchsorted(line, [base, base + MAX_LINES])
            ln, words, classes = ordered_sets(line[a:b] - base, h[a:b], rarity)
            n = min(MAX_LINES, len(row) - base)
            first = np.searchsorted(ln, np.arange(n + 1))
            size = np.diff(first)
            ok = np.flatnonzero((size >= least[0]) | ((size > 0) & (size_bytes[base : base + n] >= least[1])))
            at = row[base + ok] + lo
            yield docs[at], _line_id(hashes[at], number[base + ok]), first[ok], size[ok], words, classes


def need(total, t: float):
    """Least overlap of two sets of `total` words together that reach Jaccard t."""
    return np.ceil(t / (1 + t) * total - 1e-9).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, dtype=np.int64)
    for batch in batches:
        buf, off = textnum.string_buffers(batch.column(0))
        for lo, hi in textnum.slices(off, SLICE):
            low = fold(buf[off[lo] : off[hi]])
            s, e, _ = textnum.word_spans(low, off[lo : hi + 1] - off[lo])
            np.add.at(counts, (textnum.span_hashes(low, s, e) >> U64(44)).astype(np.int64), 1)
    part = np.minimum(counts, (1 << 31) - 1).astype(np.uint32).reshape(-1, PIECE)
    keep = np.flatnonzero(part.any(axis=1))
    yield pa.record_batch({"piece": pa.array(keep.astype(np.int32)), "counts": pa.array([part[i].tobytes() for i in keep], pa.binary())})


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = np.frombuffer(c, dtype=np.uint32).astype(np.int64)
            total[i] = total[i] + c if i in total else c
    yield pa.record_batch({"piece": pa.array(list(total), pa.int32()), "counts": pa.array([c.tobytes() for c in total.values()], pa.binary())})


def word_counts(base: DataFrame) -> np.ndarray:
    """Words of all texts in each cell."""
    kind = "piece int, counts binary"
    rows = base.select("text").mapInArrow(_count_words, kind).repartition("piece").mapInArrow(_sum_counts, kind).collect()
    counts = np.zeros((CELLS // PIECE, PIECE), dtype=np.int64)
    for r in rows:
        counts[r["piece"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return counts.reshape(-1)


# ---- postings: packed columns, so that a row of the shuffle holds all that a task sends to one partition

#: Sizes up to which 64 parity bits do, and those for 128, 256, 512 and 1024 bits; beyond, 2048.
_WIDTHS = np.array([24, 80, 200, 460, 1000])
_COLUMNS = [("word", U64), ("doc", np.int64), ("hash", np.uint32), ("number", np.uint32), ("set", U64), ("size", np.uint32), ("pos", np.uint32)]
_ALL = [*(n for n, _ in _COLUMNS), "parity", "set2"]


def width_class(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(_WIDTHS, size)


def wide_parity(w: np.ndarray, first: np.ndarray, size: np.ndarray, kind: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each class of larger sets, or of the given classes: their numbers, and a parity map each."""
    out = {}
    kind = width_class(size) if kind is None else kind
    for k in range(1, len(_WIDTHS) + 1):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        bits = 64 << k
        n = size[rows]
        at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(np.arange(len(rows)) * bits, n) + (w[at] % U64(bits)).astype(np.int64)
        odd = (np.bincount(cell, minlength=len(rows) * bits) & 1).astype(bool)
        out[k] = rows, np.packbits(odd).view(U64).reshape(len(rows), bits // 64)
    return out


def sketches(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Both halves of the digest, the 64-bit parity map and the wide maps of each set; the parts of a wide map give the narrow one by xor."""
    w = textnum.mix(words + U64(0x632BE59BD9B4E019))
    parity = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(U64(1) << ((w & U64(63)) ^ U64(7)))]) if len(w) else np.zeros(1, U64)
    halves = []
    for x in (w, textnum.mix(w + U64(0x9FB21C651E98DF25))):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(x)])
        halves.append(textnum.mix(sums[first + size] - sums[first] + size.astype(U64)))
    return *halves, parity[first + size] ^ parity[first], wide_parity(w, first, size)


def _line_id(text_hash: np.ndarray, number: np.ndarray) -> np.ndarray:
    return (text_hash.astype(np.int64) << 32) | number.astype(np.int64)


def pack(c: dict[str, np.ndarray], wide: dict[int, np.ndarray], rows: np.ndarray) -> bytes:
    """Postings `rows`, ascending; `wide` has a map for each posting of its class, in order."""
    body = [np.ascontiguousarray(np.diff(c[n][rows], prepend=c[n].dtype.type(0)) if n == "doc" else c[n][rows]).tobytes() for n, _ in _COLUMNS]
    body.append(c["set2"][rows[c["pos"][rows] == 0]].tobytes())
    kind = c["kind"][rows]
    body.append(c["parity"][rows[kind == 0]].tobytes())
    body += [m[c["nth"][rows[kind == k]]].tobytes() for k, m in sorted(wide.items())]
    return struct.pack("<q", len(rows)) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    n = struct.unpack_from("<q", blob)[0]
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    c, at = {}, 0
    for name, kind in _COLUMNS:
        c[name] = np.frombuffer(raw, kind, n, at)
        at += c[name].nbytes
    c["doc"] = np.cumsum(c["doc"])
    head = c["pos"] == 0
    c["set2"] = np.zeros(n, U64)
    c["set2"][head] = np.frombuffer(raw, U64, int(head.sum()), at)
    at += 8 * int(head.sum())
    wide = {}
    classes = width_class(c["size"])
    c["parity"] = np.empty(n, U64)
    for k in range(len(_WIDTHS) + 1):
        rows = np.flatnonzero(classes == k)
        maps = np.frombuffer(raw, U64, len(rows) << k, at).reshape(len(rows), 1 << k)
        at += maps.nbytes
        c["parity"][rows] = np.bitwise_xor.reduce(maps, axis=1)
        if k:
            wide[k] = maps
    return c, wide


def _numbered(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Adds the width class of each posting and the place of its map among those of the class."""
    c["kind"] = width_class(c["size"])
    c["nth"] = np.zeros(len(c["kind"]), np.int64)
    for k in range(1, len(_WIDTHS) + 1):
        rows = np.flatnonzero(c["kind"] == k)
        c["nth"][rows] = np.arange(len(rows))
    return c


def _join(parts: list[tuple[dict, dict]]) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    c = {n: np.concatenate([p[0][n] for p in parts]) for n in _ALL}
    return _numbered(c), {k: np.concatenate([p[1][k] for p in parts]) for k in parts[0][1]}


def _take(c: dict[str, np.ndarray], wide: dict[int, np.ndarray], rows: np.ndarray) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    out = {n: c[n][rows] for n in _ALL}
    maps = {k: m[c["nth"][rows[c["kind"][rows] == k]]] for k, m in wide.items()}
    return _numbered(out), maps


def _postings(shared, t: float, least: tuple[int, int], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        held, many = [], 0
        for batch in batches:
            for docs, at, first, size, words, classes in line_sets(batch, rarity, least):
                if not len(docs):
                    continue
                held.append(_piece_postings(docs, at, first, size, words, classes, t))
                many += len(held[-1][0]["word"])
                if many >= PACK:
                    yield _packed(held, parts)
                    held, many = [], 0
        if many:
            yield _packed(held, parts)
        trim()

    return run


def _piece_postings(docs, at, first, size, words, classes, t: float) -> tuple[dict[str, np.ndarray], dict[int, np.ndarray]]:
    set1, set2, parity, wide = sketches(words, first, size)
    # a set that came earlier in the piece: one posting says that the line goes
    order = np.lexsort((at, docs, set2, set1))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (set1[order][1:] == set1[order][:-1]) & (set2[order][1:] == set2[order][:-1]) & (size[order][1:] == size[order][:-1])
    lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    gone = np.zeros(len(order), dtype=bool)
    gone[order] = same & ((docs[order] != docs[lead]) | (at[order] != at[lead]))
    drop = np.zeros(len(order), dtype=bool)
    drop[order] = same
    prefix = np.where(drop, 0, size - np.ceil(t * size - 1e-9).astype(np.int64) + 1)
    line = np.repeat(np.arange(len(docs)), prefix)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    word = first[line] + pos
    keep = classes[word] != ONCE  # a word that occurs once leads to no other line
    line, pos, word = line[keep], pos[keep], words[word[keep]]
    extra = np.flatnonzero(gone)
    line, pos = np.concatenate([line, extra]), np.concatenate([pos, np.full(len(extra), GONE)])
    word = np.concatenate([word, textnum.mix(docs[extra].view(U64) ^ textnum.mix(at[extra].view(U64)))])
    c = {
        "word": word, "doc": docs[line], "hash": (at[line] >> 32).astype(np.uint32), "number": at[line].astype(np.uint32), "set": set1[line],
        "size": np.where(pos == GONE, 0, size[line]).astype(np.uint32), "pos": pos.astype(np.uint32), "parity": parity[line], "set2": np.where(pos == 0, set2[line], U64(0)),
    }
    kind = width_class(c["size"])
    maps = {}
    for k in range(1, len(_WIDTHS) + 1):
        rows = line[kind == k]
        if k in wide:
            place = np.zeros(len(docs), np.int64)
            place[wide[k][0]] = np.arange(len(wide[k][0]))
            maps[k] = wide[k][1][place[rows]]
        else:
            maps[k] = np.zeros((0, 1 << k), U64)
    return c, maps


def _packed(held: list, parts: int) -> pa.RecordBatch:
    c, wide = _join(held)
    part = (textnum.mix(c["word"].copy()) % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    ids = np.flatnonzero(np.diff(cut))
    blobs = [pack(c, wide, order[cut[i] : cut[i + 1]]) for i in ids]
    return pa.record_batch({"part": pa.array(ids.astype(np.int32)), "blob": pa.array(blobs, pa.binary())})


# ---- candidates in the groups of words

#: Kind 0: a line whose set came earlier.  1: a line's closest candidate in a word's group, and whether it has more.
#: 2: two lines of a component that closest candidates don't join.  3: a hot word and the number of its postings.
_SHARED = "kind byte, word long, n long, doc long, at long, y_doc long, y_at long, slack int, more boolean"
_ARROW = {
    "kind": pa.int8(), "word": pa.int64(), "n": pa.int64(), "doc": pa.int64(), "at": pa.int64(), "y_doc": pa.int64(), "y_at": pa.int64(),
    "slack": pa.int32(), "more": pa.bool_(),
}


def _rows(kind: int, many: int, **cols) -> Iterator[pa.RecordBatch]:
    made = {"kind": pa.array(np.full(many, kind, np.int8)), **cols}
    t = pa.table({m: made[m] if m in made else pa.nulls(many, k) for m, k in _ARROW.items()})
    yield from t.to_batches(max_chunksize=50000)


def _at(c: dict[str, np.ndarray]) -> np.ndarray:
    return _line_id(c["hash"].view(np.int32), c["number"])


def _collapse(c: dict[str, np.ndarray], wide: dict[int, np.ndarray]) -> tuple[dict, dict, np.ndarray]:
    """The postings without those of sets that came earlier, and the rows of the lines that go."""
    at = _at(c)
    same = textnum.mix(c["word"] ^ textnum.mix(c["set"] + c["size"].astype(U64)))
    order = np.lexsort((at, c["doc"], same))
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for n in ("word", "set", "size", "set2"):
        v = c[n][order]
        new[1:] |= v[1:] != v[:-1]
    pos = c["pos"][order]
    new |= pos == GONE
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = ~new & (pos == 0) & ((c["doc"][order] != c["doc"][lead]) | (at[order] != at[lead]))
    gone = order[later | (pos == GONE)]
    keep = np.sort(order[new & (pos != GONE)])
    return *_take(c, wide, keep), np.stack([c["doc"][gone], at[gone]])


def _share(t: float, together: int):
    """From the postings of whole words: repeated sets, candidates, and words with too many postings for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, limit = [], 0, HOLD
        hot: dict[int, int] = {}

        def settle():
            c, wide, gone = _collapse(*_join(held))
            order = np.argsort(c["word"], kind="stable")
            start = np.flatnonzero(_new(c["word"][order]))
            count = np.diff(np.append(start, len(order)))
            names = c["word"][order[start]]
            over = count > together
            if hot:
                over |= np.isin(names, np.array(list(hot), U64))
            for w, n in zip(names[over].tolist(), count[over].tolist()):
                hot[w] = hot.get(w, 0) + n
            return c, wide, gone, order, start, count, over

        for batch in batches:
            for x in batch.column(1):
                held.append(unpack(x.as_py()))
                many += len(held[-1][0]["word"])
            if many > limit:
                c, wide, gone, order, _, count, over = settle()
                yield from _rows(0, gone.shape[1], doc=pa.array(gone[0]), at=pa.array(gone[1]))
                held = [_take(c, wide, np.sort(order[~np.repeat(over, count)]))]
                many = len(held[0][0]["word"])
                limit = max(HOLD, 2 * many)
        if held:
            c, wide, gone, order, _, count, over = settle()
            held = []
            yield from _rows(0, gone.shape[1], doc=pa.array(gone[0]), at=pa.array(gone[1]))
            use = (count > 1) & ~over
            order = order[np.repeat(use, count)]
            bounds = np.concatenate([[0], np.cumsum(count[use])])
            for lo, hi in textnum.slices(bounds, CHUNK):
                yield from _share_words(*_take(c, wide, order[bounds[lo] : bounds[hi]]), t)
        if hot:
            yield from _rows(3, len(hot), word=pa.array(np.array(list(hot), U64).view(np.int64)), n=pa.array(list(hot.values()), pa.int64()))
        held = None
        trim()

    return run


def _new(*cols: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the row before in any of the columns."""
    out = np.zeros(len(cols[0]), dtype=bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _order(c: dict[str, np.ndarray], t: float) -> np.ndarray:
    """Adds what `candidates` reads to postings that are grouped by word, and returns their order by group, size class and line."""
    c["at"] = _at(c)
    order = np.lexsort((c["at"], c["doc"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(_new(c["doc"][order], c["at"][order])) - 1
    c["size"], c["pos"] = c["size"].astype(np.int64), c["pos"].astype(np.int64)
    step = max(np.log(1 / t), 0.005) * 1.000001  # sizes that may match lie in the same or in neighbouring classes
    klass = np.floor(np.log(c["size"]) / step).astype(np.int64) + 1
    c["key"] = ((np.cumsum(_new(c["word"])) - 1) << 44) | (klass << 32) | rank
    return np.argsort(c["key"])


def fits(c: dict[str, np.ndarray], wide: dict[int, np.ndarray], x: np.ndarray, y: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of postings pass the length, positional and parity filters, and by how many words they do."""
    sx, sy = c["size"][x], c["size"][y]
    total = sx + sy
    least = need(total, t)
    spare = total - 2 * least  # words that may be in one set only
    slack = spare - np.bitwise_count(c["parity"][x] ^ c["parity"][y])
    live = np.flatnonzero((slack >= 0) & (np.minimum(sx, sy) >= t * np.maximum(sx, sy) - 1e-9))
    x, y, slack = x[live], y[live], slack[live]
    px, py = c["pos"][x], c["pos"][y]
    room = np.minimum(px, py) + np.minimum(c["size"][x] - px, c["size"][y] - py)
    ok = room >= least[live]
    live, x, y, slack = live[ok], x[ok], y[ok], slack[ok]
    kind = c["kind"][x]
    both = (kind > 0) & (kind == c["kind"][y])
    for k in np.unique(kind[both]):
        at = np.flatnonzero(both & (kind == k))
        far = np.bitwise_count(wide[k][c["nth"][x[at]]] ^ wide[k][c["nth"][y[at]]]).sum(axis=1, dtype=np.int64)
        slack[at] = np.minimum(slack[at], spare[live[at]] - far)
    ok = slack >= 0
    return live[ok], slack[ok]


class Components:
    """Rows joined by pairs; `label` has the first row of each one's component."""

    def __init__(self, many: int):
        self.label = np.arange(many)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.label[self.label]) != self.label).any():
                self.label = up


def candidates(c, wide, key: np.ndarray, open_rows: np.ndarray, t: float, *, seen=None, joined: Components | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line, earlier line of its group that passes the filters, slack) by blocks; rows in the order of `key`.

    A line is dropped once `seen` says so.  With `joined`, pairs of a component
    are left out for lines that have `MOST` already.
    """
    found = np.zeros(len(key), np.int64)
    rank = key & ((1 << 32) - 1)
    for d in (0, -1, 1):
        base = key - rank + (d << 32)
        low, high = np.searchsorted(key, base), np.searchsorted(key, base + rank)
        x = open_rows[low[open_rows] < high[open_rows]]
        at = low[x]
        while True:
            if seen is not None:
                left = ~seen[x]
                x, at = x[left], at[left]
            if not len(x):
                break
            many = max(1, CHUNK // len(x))
            i, j = np.repeat(x, many), (at[:, None] + np.arange(many)).reshape(-1)
            inside = j < high[i]
            i, j = i[inside], j[inside]
            if joined is not None:
                use = (found[i] < MOST) | (joined.label[i] != joined.label[j])
                i, j = i[use], j[use]
            live, slack = fits(c, wide, i, j, t)
            i, j = i[live], j[live]
            if joined is not None:
                np.add.at(found, i, 1)
                joined.join(i, j)
            yield i, j, slack
            at = at + many
            left = at < high[x]
            x, at = x[left], at[left]


def _share_words(c: dict[str, np.ndarray], wide: dict[int, np.ndarray], t: float) -> Iterator[pa.RecordBatch]:
    """The closest candidate of each line in each group, and what joins its component, for postings grouped by word."""
    order = _order(c, t)
    c = {n: v[order] for n, v in c.items()}
    joined = Components(len(order))
    rank = c["key"] & ((1 << 32) - 1)
    best, slacks, found = np.full(len(order), -1), np.full(len(order), -1), np.zeros(len(order), np.int64)
    for x, y, slack in candidates(c, wide, c["key"], np.arange(len(order)), t, joined=joined):
        if not len(x):
            continue
        np.add.at(found, x, 1)
        near = np.lexsort((rank[y], -slack, x))
        lead = near[_new(x[near])]
        x, y, slack = x[lead], y[lead], slack[lead]
        closer = (slack > slacks[x]) | ((slack == slacks[x]) & (rank[y] < rank[best[x]]))
        best[x[closer]], slacks[x[closer]] = y[closer], slack[closer]
    i = np.flatnonzero(best >= 0)
    if not len(i):
        return
    j = best[i]
    pair = lambda i, j: {n: pa.array(c[n][i]) for n in LINE} | {f"y_{n}": pa.array(c[n][j]) for n in LINE}
    yield from _rows(1, len(i), word=pa.array(c["word"][i].view(np.int64)), more=pa.array(found[i] > 1), slack=pa.array(slacks[i].astype(np.int32)), **pair(i, j))
    trees = Components(len(order))
    trees.join(i, j)
    tops = np.flatnonzero((trees.label == np.arange(len(order))) & (joined.label != np.arange(len(order))))
    if len(tops):
        yield from _rows(2, len(tops), **pair(tops, joined.label[tops]))


# ---- verification

def overlaps(codes: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common words of the sets i and j; `codes` are 32-bit numbers of the words."""

    def flat(k: np.ndarray) -> np.ndarray:
        n = off[k + 1] - off[k]
        return (np.repeat(np.arange(len(k)), n) << 32) | codes[np.repeat(off[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    both = np.sort(np.concatenate([flat(i), flat(j)]))
    return np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=len(i))


def _coded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(raw.view(U64), return_inverse=True)[1].astype(np.int64), off // 8


def _matching(codes: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    size = np.diff(off)
    out = np.zeros(len(i), dtype=bool)
    ends = np.concatenate([[0], np.cumsum(size[i] + size[j])])
    for lo, hi in textnum.slices(ends, 1 << 20):
        a, b = i[lo:hi], j[lo:hi]
        out[lo:hi] = overlaps(codes, off, a, b) >= need(size[a] + size[b], t)
    return out


def _sets_of(rarity, wanted, least: tuple[int, int]):
    def run(batches):
        table = BitTable(wanted.value)
        for batch in batches:
            docs, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            batch = batch.filter(pa.array(table.has(docs, _line_id(hashes, np.array(ANY)))))
            if not batch.num_rows:
                continue
            for doc, at, first, size, words, _ in line_sets(batch, rarity.value, least):
                ok = table.has(doc, at)
                if ok.any():
                    yield pa.record_batch({"doc": doc[ok], "at": at[ok], "words": _binary(words, first[ok], size[ok])})
        trim()

    return run


def _binary(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    ends = np.concatenate([[0], np.cumsum(size) * 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(words[at].tobytes())])


ANY = GONE  # in place of a line's number: any line of the document


def _verify(t: float):
    """Lines x that match y; rows are (hub, part, doc, at, words) of sets and (hub, part, doc, at, y_doc, y_at) of pairs, by hub and part."""
    schema = pa.schema([("doc", pa.int64()), ("at", pa.int64())])

    def fn(table: pa.Table) -> pa.Table:
        group = np.zeros(table.num_rows, np.int64)
        group[group_bounds(table, ["hub", "part"])[1:-1]] = 1
        group = np.cumsum(group)
        is_set = table["words"].is_valid().to_numpy()
        sets, pairs = np.flatnonzero(is_set), np.flatnonzero(~is_set)
        doc, at = table["doc"].to_numpy(), table["at"].to_numpy()
        codes, off = _coded(*textnum.string_buffers(table["words"].take(pa.array(sets))))

        def find(d: np.ndarray, a: np.ndarray) -> np.ndarray:
            """The number of the set of each pair's line."""
            both = (np.concatenate([v[0][sets], v[1]]) for v in ((group, group[pairs]), (doc, d), (at, a)))
            g, d, a = both
            order = np.lexsort((np.arange(len(g)) >= len(sets), a, d, g))
            new = _new(g[order], d[order], a[order])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            out = np.empty(len(order), np.int64)
            out[order] = lead
            return out[len(sets) :]

        pick = table.select(["y_doc", "y_at"]).take(pa.array(pairs))
        x, y = find(doc[pairs], at[pairs]), find(pick["y_doc"].to_numpy(), pick["y_at"].to_numpy())
        hit = pairs[_matching(codes, off, x, y, t)]
        return pa.table({"doc": doc[hit], "at": at[hit]})

    return grouped(["hub", "part"], fn, schema)


def _matched(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Lines x of the pairs (x, y, hub) whose Jaccard with y reaches t; a set travels once for each hub of its pairs."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / 50000).cast("int").alias("parts"))
    cut = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64(*X), "parts").cast("int").alias("part"), *X, *Y)
    lines = cut.select("hub", "part", *[F.col(n).alias(m) for n, m in zip(X, LINE)]).union(cut.select("hub", "part", *Y)).distinct()
    whole = lines.join(sets, LINE).select("hub", "part", *LINE, F.lit(None).cast("long").alias("y_doc"), F.lit(None).cast("long").alias("y_at"), "words")
    given = cut.select("hub", "part", *[F.col(n).alias(m) for n, m in zip(X, LINE)], *Y, F.lit(None).cast("binary").alias("words"))
    rows = whole.union(given).repartition("hub", "part").sortWithinPartitions("hub", "part")
    return rows.mapInArrow(_verify(t), "doc long, at long").distinct()


def _rescan(rarity, wanted, t: float, least: tuple[int, int]):
    """The whole sets of the lines that have one of the wanted words in their prefix, for each such word."""

    def run(batches):
        table = BitTable(wanted.value)
        for batch in batches:
            for doc, at, first, size, words, _ in line_sets(batch, rarity.value, least, lambda h: table.has(h.view(np.int64))):
                prefix = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
                line = np.repeat(np.arange(len(doc)), prefix)
                word = words[first[line] + np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)].view(np.int64)
                ok = table.has(word)
                line, word = line[ok], word[ok]
                for lo, hi in textnum.slices(np.concatenate([[0], np.cumsum(size[line])]), 1 << 18):
                    part = line[lo:hi]
                    yield pa.record_batch({"word": word[lo:hi], "doc": doc[part], "at": at[part], "words": _binary(words, first[part], size[part])})
        trim()

    return run


def _sharp(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parity maps of 2048 bits for all sets: next to the whole number of words that are in one of two sets only."""
    w = textnum.mix(words + U64(0x632BE59BD9B4E019))
    top = len(_WIDTHS)
    out = [np.zeros((0, 1 << top), U64)]
    for lo in range(0, len(size), 2048):  # counts of cells take 16 KB a set meanwhile
        part = slice(lo, lo + 2048)
        out.append(wide_parity(w, first[part], size[part], np.full(len(size[part]), top))[top][1])
    return np.concatenate(out)


def _compare_all(t: float):
    """Open lines of each (hub, cell) that match an earlier line of it; rows are (hub, cell, doc, at, open, words), by hub and cell.

    Pairs that share a word of their prefixes, which `words` begin with, pass the same filters as in the groups of words.
    """
    schema = pa.schema([("doc", pa.int64()), ("at", pa.int64())])

    def fn(table: pa.Table) -> pa.Table:
        raw, off = textnum.string_buffers(table["words"])
        codes, off = _coded(raw, off)
        size, first = np.diff(off), off[:-1]
        words = raw.view(U64)
        _, _, parity, wide = sketches(words, first, size)
        sharp = _sharp(words, first, size)
        doc, at = table["doc"].to_numpy(), table["at"].to_numpy()
        asked = table["open"].to_numpy(zero_copy_only=False)
        nth = np.zeros(len(at), np.int64)
        for rows, _ in wide.values():
            nth[rows] = np.arange(len(rows))
        maps = {k: m for k, (_, m) in wide.items()}
        group = np.repeat(np.arange(len(bounds := group_bounds(table, ["hub", "cell"])) - 1), np.diff(bounds))
        prefix = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
        line = np.repeat(np.arange(len(at)), prefix)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
        word = words[first[line] + pos]
        order = np.lexsort((word, group[line]))
        line, pos, word = line[order], pos[order], word[order]
        start = np.flatnonzero(_new(word, group[line]))
        count = np.diff(np.append(start, len(line)))
        use = np.repeat(count > 1, count)
        line, pos, count = line[use], pos[use], count[count > 1]
        name = np.repeat(np.arange(len(count)), count).astype(U64)
        matched = np.zeros(len(at), dtype=bool)
        ends = np.concatenate([[0], np.cumsum(count)])
        for lo, hi in textnum.slices(ends, CHUNK):
            part = slice(ends[lo], ends[hi])
            row = line[part]
            c = {
                "word": name[part], "doc": doc[row], "hash": (at[row] >> 32).astype(np.int32).view(np.uint32), "number": at[row].astype(np.uint32), "size": size[row],
                "pos": pos[part], "parity": parity[row], "kind": width_class(size[row]), "nth": nth[row], "row": row,
            }
            order = _order(c, t)
            c = {n: v[order] for n, v in c.items()}
            seen = matched[c["row"]]
            for x, y, _ in candidates(c, maps, c["key"], np.flatnonzero(asked[c["row"]]), t, seen=seen):
                x, y = c["row"][x], c["row"][y]
                total = size[x] + size[y]
                far = np.bitwise_count(sharp[x] ^ sharp[y]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(far <= total - 2 * need(total, t))
                hit = x[near[_matching(codes, off, x[near], y[near], t)]]
                if len(hit):
                    matched[hit] = True
                    seen[:] = matched[c["row"]]
        return pa.table({"doc": doc[matched], "at": at[matched]})

    return grouped(["hub", "cell"], fn, schema)


def _met(lines: DataFrame, t: float) -> DataFrame:
    """Lines that match an earlier line of their hub; rows are (hub, blocks, doc, at, open, words).

    Only open lines are compared with others; a hub of several blocks is compared block by block.
    """
    many = F.greatest("blocks", F.lit(1))
    cells = (
        lines.withColumn("mine", F.pmod(F.xxhash64(*LINE), many).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
        .withColumn("cell", F.least("mine", "other").cast("long") * F.lit(1 << 32) + F.greatest("mine", "other"))
    )
    return (
        cells.select("hub", "cell", *LINE, "open", "words").repartition("hub", "cell").sortWithinPartitions("hub", "cell")
        .mapInArrow(_compare_all(t), "doc long, at long").distinct()
    )


def _hot_lines(ws: Workspace, base: DataFrame, rarity, hot: DataFrame, t: float, least: tuple[int, int], together: int) -> DataFrame:
    """The lines of the hot words' groups, for `_met`: a hot word is a hub, cut into blocks."""
    wanted = ws.spark.sparkContext.broadcast(bit_table(hot, ["word"]))
    rows = base.mapInArrow(_rescan(rarity, wanted, t, least), "word long, doc long, at long, words binary")
    homes = hot.select("word", F.col("word").alias("hub"), F.ceil(F.col("n") / max(1, together // 2)).cast("int").alias("blocks"))
    lines = rows.join(homes, "word").groupBy("hub", "blocks", *LINE).agg(F.first("words").alias("words"))
    return lines.select("hub", "blocks", *LINE, F.lit(True).alias("open"), "words")


def _component_lines(ws: Workspace, base: DataFrame, rarity, edges: DataFrame, asked: DataFrame, least: tuple[int, int], together: int) -> DataFrame:
    """The lines of all components that hold a line of `asked`, for `_met`; the component is the hub."""
    near = edges.select(*[F.col(n).alias(m) for n, m in zip(LINE, X)], *Y)
    roots = connected_components(ws, near.select(F.xxhash64(*X).alias("a"), F.xxhash64(*Y).alias("b")), "a", "b")
    lines = near.select(*X).union(near.select(*Y)).toDF(*LINE).distinct().withColumn("node", F.xxhash64(*LINE))
    lines = lines.join(asked.withColumn("open", F.lit(True)), LINE, "left").join(roots, "node", "left")
    lines = lines.select(F.coalesce("root", "node").alias("hub"), *LINE, F.coalesce("open", F.lit(False)).alias("open"))
    homes = lines.groupBy("hub").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any")
    blocks = F.when(F.col("n") > together, F.ceil(F.col("n") / max(1, together // 2))).otherwise(1).cast("int")
    members = ws.save(lines.join(homes.select("hub", blocks.alias("blocks")), "hub"), "members")
    return members.join(_sets(base, members.select(*LINE), rarity, least), LINE)


def text_hash(text: Column) -> Column:
    return F.hash(text)


def removed_lines(docs: DataFrame, *, threshold: float = 0.8, min_tokens: int = 3, min_bytes: int = 64, together: int = HOT) -> DataFrame:
    """(doc, at) of every line that an earlier line matches: doc_id, and text hash and line number in one.

    Groups of more than `together` lines are compared in blocks.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "line-dedup")
    least, t = (min_tokens, min_bytes), threshold
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), text_hash(text).alias("text_hash"), text.alias("text")).where("doc is not null and text is not null")
    counts = word_counts(base)
    rarity = spark.sparkContext.broadcast(rarity_classes(counts))
    tokens = int(counts.sum())  # a posting takes some 40 bytes, and a fifth of the words give one
    parts = max(-(-8 * tokens // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // 250_000)), 1)
    shared = ws.save(
        base.mapInArrow(_postings(rarity, t, least, parts), "part int, blob binary").repartitionById(parts, F.col("part")).mapInArrow(_share(t, together), _SHARED),
        "shared",
    )
    repeated = shared.where("kind = 0").select(*LINE)
    found = shared.where("kind = 1")
    pairs = found.select(*[F.col(n).alias(f"x_{n}") for n in LINE], *Y, "slack", "more")
    y = F.struct(*Y)
    closest = pairs.groupBy(*X).agg(
        F.min(F.struct((-F.col("slack")).alias("far"), *Y)).alias("best"), (F.max("more") | (F.min(y) != F.max(y))).alias("more")
    )
    first = closest.select(*X, *[F.col(f"best.{n}").alias(n) for n in Y], "more")
    first = ws.save(first.withColumn("hub", F.xxhash64(*Y)), "first")
    hits = ws.save(_matched(first, _sets(base, _lines(first), rarity, least), t), "hits")

    asked = ws.save(first.where("more").select(*X).toDF(*LINE).join(hits, LINE, "left_anti"), "asked")
    out = repeated.union(hits)
    if not asked.isEmpty():
        out = out.union(_met(_component_lines(ws, base, rarity, shared.where("kind in (1, 2)"), asked, least, together), t))
    hot = shared.where("kind = 3").select("word", "n")
    if not hot.isEmpty():
        out = out.union(_met(_hot_lines(ws, base, rarity, hot, t, least, together), t))
    out = ws.save(out.distinct(), "removed")
    ws.drop(shared, first, hits, asked)
    return out


def _lines(pairs: DataFrame) -> DataFrame:
    return pairs.select(*X).union(pairs.select(*Y)).toDF(*LINE)


def _sets(base: DataFrame, lines: DataFrame, rarity, least: tuple[int, int]) -> DataFrame:
    """(doc, at, words) of the lines, once each; the bit table only saves shuffling other lines."""
    any_line = lines.select("doc", F.col("at").bitwiseOR(F.lit(ANY)).alias("at"))
    wanted = base.sparkSession.sparkContext.broadcast(bit_table(lines.union(any_line), LINE))
    return base.mapInArrow(_sets_of(rarity, wanted, least), "doc long, at long, words binary").repartition(*LINE).dropDuplicates(LINE)


def drop_repeated_lines(docs: DataFrame, *, count: str | None = None, **options) -> DataFrame:
    """`docs` with the text of the lines that stay; `count` names an extra column for the number of lines removed.

    Only documents that may have lost lines are shuffled.  Options: those of
    `removed_lines`.
    """
    gone = removed_lines(docs, **options)
    doc, hashed, lines, key, key_hash, split = free_names([*docs.columns, count or ""], "doc", "hash", "lines", "key", "key_hash", "split")
    lists = gone.groupBy(F.col("doc").alias(doc), F.expr("cast(at >> 32 as int)").alias(hashed)).agg(
        F.collect_set(F.expr("cast(at & 4294967295 as int)")).alias(lines)
    )
    touched_docs = gone.select("doc", F.expr("at >> 32").alias("hash")).distinct()
    text = F.col("text").cast("string")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(key_hash, F.when(text.isNotNull(), text_hash(text)))
    touched = may_have(touched_docs, F.col(key), F.col(key_hash).cast("long"))
    both = keyed.where(touched).join(lists, (F.col(key) == F.col(doc)) & (F.col(key_hash) == F.col(hashed)), "left")
    both = both.withColumn(split, F.when(F.col(lines).isNotNull(), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lines))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n")
    names = [c for c in docs.columns if c != count]
    cols = [F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    extra = [F.coalesce(F.size(lines), F.lit(0)).alias(count)] if count else []
    rest = keyed.where(~touched).select(*[F.col(f"`{c}`") for c in names], *([F.lit(0).alias(count)] if count else []))
    return both.select(*cols, *extra).union(rest)
