"""Operator 9: token counts of fields and sections from one encoding of the whole document.

A document is encoded once, whole.  Token lengths give every token's span, at
byte resolution, and the spans are interval-joined to the spans of the fields
or sections.  A token that crosses a boundary goes to one of them by rule:

* "overlap" (default): where most of its bytes lie; ties go to the earlier one.
* "start": where its first byte lies.
* "end": where its last byte lies.

So the counts of a document add up to the tokens of its whole text.

Defined results
---------------
* Sections are lines; a line's end belongs to the line.  A document always has
  section 0: the empty text has one section of 0 tokens.
* A null text has no sections.  A null field counts as empty.
* Null doc_ids stay null; repeated rows each give their own sections.
* Further columns aren't read, so their names can't clash.
* Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.bpe import PATTERN, VOCABULARY, broadcast_vocabulary, codec
from glyphmill.llm.common import bounded

RULES = ("overlap", "start", "end")
ROWS_AT_ONCE = 500


def allocate(token_ends: np.ndarray, starts: np.ndarray, rule: str = "overlap") -> np.ndarray:
    """The span of each token, for spans that begin at `starts` (ascending, from 0) and tile the text."""
    begin = np.concatenate([[0], token_ends]).astype(np.int64)[:-1]
    first = np.searchsorted(starts, begin, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(starts, token_ends - 1, side="right") - 1
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(last > first):
        edge = np.concatenate([[begin[i]], starts[first[i] + 1 : last[i] + 1], [token_ends[i]]])
        out[i] = first[i] + int(np.argmax(np.diff(edge)))
    return out


def _char_index(buf: np.ndarray) -> np.ndarray:
    """Characters before each byte offset, 0 to len(buf)."""
    out = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def count_by_section(
    docs: DataFrame, *, rule: str = "overlap", vocabulary: str = VOCABULARY, pattern: str = PATTERN
) -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens) of every line of every text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for whole in bounded(batches, 1):
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                texts = batch.column(1)
                buf, off = textnum.string_buffers(texts)
                ids, _ = c.encode_column(texts.to_pylist())
                ends = np.cumsum(c.lengths[ids])
                lines = np.flatnonzero(buf == 10) + 1
                lines = lines[~np.isin(lines, off[1:])]
                starts = np.concatenate([off[:-1], lines])
                row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, lines, side="right") - 1])
                order = np.lexsort((row, starts))
                starts, row = starts[order], row[order]
                count = np.bincount(allocate(ends, starts, rule), minlength=len(starts))
                stop = np.append(starts[1:], len(buf))
                head = np.searchsorted(row, np.arange(len(off) - 1))
                chars = _char_index(buf)
                base = chars[off[:-1]][row]
                has = ~np.asarray(texts.is_null())[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row[has])),
                        pa.array((np.arange(len(row)) - head[row])[has].astype(np.int32)),
                        pa.array((chars[starts] - base)[has]),
                        pa.array((chars[stop] - base)[has]),
                        pa.array(count[has].astype(np.int32)),
                    ],
                    names=["doc_id", "section", "char_start", "char_end", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, section int, char_start long, char_end long, n_tokens int"
    )


def count_by_field(
    rows: DataFrame, key: str, fields: list[str], *, separator: str = "\n", rule: str = "overlap",
    vocabulary: str = VOCABULARY, pattern: str = PATTERN,
) -> DataFrame:
    """(key, field, n_tokens): the fields are joined by `separator`, which counts with the field before it.

    A key column named like one of the other two is returned as `key`.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    out_key = "key" if key.lower() in ("field", "n_tokens") else key
    shared = broadcast_vocabulary(rows.sparkSession, vocabulary)
    parts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(p, F.lit(separator)) if i + 1 < len(parts) else p for i, p in enumerate(parts)]
    source = rows.select(F.col(f"`{key}`").alias("__gm_key"), *[p.alias(f"__gm_{i}") for i, p in enumerate(parts)])
    kind = source.schema["__gm_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        for batch in batches:
            cols = [batch.column(i + 1).to_pylist() for i in range(len(fields))]
            counts = np.zeros((batch.num_rows, len(fields)), dtype=np.int32)
            for r, row in enumerate(zip(*cols)):
                ids = np.frombuffer(c.encode_bytes("".join(row)), dtype=np.int32)
                size = [len(p.encode()) for p in row]
                starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
                counts[r] = np.bincount(allocate(np.cumsum(c.lengths[ids]), starts, rule), minlength=len(fields))
            at = np.repeat(np.arange(batch.num_rows), len(fields))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(fields * batch.num_rows, pa.string()),
                    pa.array(counts.reshape(-1)),
                ],
                names=[out_key, "field", "n_tokens"],
            )

    return source.mapInArrow(run, f"`{out_key}` {kind}, field string, n_tokens int")
