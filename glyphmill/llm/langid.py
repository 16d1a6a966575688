"""Operator 1: language identification.

A text is the average of the embeddings of its hashed subwords (byte runs of 2
to 4 within words, with word ends marked), followed by a linear softmax.  Both
are trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, of which a part is held out for calibration:

* the softmax temperature minimises the held-out log loss;
* a text is rejected if its calibrated probability is under a threshold: the
  `max_loss` quantile of the held-out probabilities of the true labels, but
  never more than 0.5 (what is more likely right than wrong isn't rejected)
  and never under 1.5 times the probability of a blind guess;
* or if too few of its subwords were seen in training: under half the
  `max_loss` quantile of the held-out shares;
* or if its subwords aren't those of the language found: the mean logarithm of
  their frequencies in the training texts of that language is compared with the
  held-out texts' median; texts of under FULL subwords may lie further off.
  The bound is the `max_loss` quantile of the held-out values, times `SLACK`, but
  never above `USUAL`.
  That is what rejects other languages and code, which a softmax over the known
  labels can't.

Because the model is linear after the average, each bucket's class scores are
computed once; classifying is a table lookup and a sum, over whole texts.

Defined results
---------------
* Null text, and text without a letter, digit or non-ASCII character: null
  language, probability 0, rejected.
* Rows without a label or text aren't trained on.  Without any labelled row
  nothing is known, and every text is rejected.
* Repeated rows get the same result; ties between languages go to the one that
  sorts first.
* Very long texts are read whole; null doc_ids stay null.
* Further columns: `identify` doesn't read them, `keep_identified` passes them
  through, whatever their names.
* Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import textnum
from glyphmill.llm.common import bound_batches, free_names
from glyphmill.llm.line_dedup import fold

BITS = 18
BUCKETS = 1 << BITS
SIZES = (2, 3, 4)
SLICE = 1 << 18
#: Subwords beyond which a longer text doesn't scatter less.
FULL = 50
SLACK = 1.1
#: Subwords that are on average e**3 times as rare as in usual texts, or less, are never a reason to reject.
USUAL = -3.0
#: Bound of the training sample, in rows for each label.
ROWS_PER_LABEL = 600

_SPACED = np.where(textnum.IS_WORD, np.arange(256), 32).astype(np.uint8)
_SPACED[48:58] = 32


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # (labels, BUCKETS): class scores of each subword, already divided by the temperature
    bias: np.ndarray
    known: np.ndarray  # buckets seen in training
    least_probability: float
    least_known: float
    typical: np.ndarray  # (labels, BUCKETS): log frequency of each subword in a label's training texts, less the label's held-out mean
    least_typical: float
    held_out_accuracy: float


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every subword of every row, in the order of rows for each size."""
    rows = len(off) - 1
    text = np.full(len(buf) + rows + 1, 32, dtype=np.uint8)  # a space before each row and at the end
    at = np.arange(len(buf)) + np.repeat(np.arange(1, rows + 1), np.diff(off))
    text[at] = _SPACED[fold(buf)]
    solid = text != 32
    out, owner = [], []
    starts = off[:-1] + np.arange(rows)
    wide = text.astype(np.uint32)
    for n in SIZES:
        m = len(text) - n + 1
        if m <= 0:
            continue
        pack = wide[:m].copy()
        inner = np.ones(m, dtype=bool)
        for i in range(1, n):
            pack = (pack << np.uint32(8)) | wide[i : i + m]
            if i < n - 1:
                inner &= solid[i : i + m]  # spaces only at the ends
        if n == 2:
            inner &= solid[:m] & solid[1 : m + 1]
        h = ((pack ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) ^ np.uint32(n << 13)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        pos = np.flatnonzero(inner)
        out.append(h[pos].astype(np.int64))
        owner.append(np.searchsorted(starts, pos, side="right") - 1)
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def _train(
    bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, dim: int, epochs: int, rate: float, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    known = np.zeros(BUCKETS, dtype=bool)
    for b, _ in bags:
        known[b] = True
    place = np.cumsum(known) - 1
    e = rng.uniform(-1 / dim, 1 / dim, (int(known.sum()), dim)).astype(np.float32)
    w = np.zeros((n_labels, dim), dtype=np.float32)
    bias = np.zeros(n_labels, dtype=np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            lr = rate * (1 - done / steps)
            done += 1
            b, share = bags[i]
            at = place[b]
            v = share @ e[at]
            z = w @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w.T @ p
            w -= lr * np.outer(p, v)
            bias -= 0.01 * lr * p
            e[at] -= (lr * len(at) ** 0.5) * np.outer(share, back)
    full = np.zeros((BUCKETS, dim), dtype=np.float32)
    full[known] = e
    return full, w, bias, known


def fit(
    docs: DataFrame, *, rows_per_label: int = ROWS_PER_LABEL, held_out: float = 0.25, max_loss: float = 0.001, dim: int = 16,
    epochs: int = 5, rate: float = 0.5, seed: int = 5,
) -> Model:
    """Trains and calibrates on at most `rows_per_label` labelled rows for each label, chosen by hash."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    labelled = docs.select(F.col("lang").cast("string").alias("label"), text.alias("text"), F.xxhash64(text).alias("order")).where(
        "label is not null and text is not null and text <> ''"
    )
    nth = labelled.select("label", "order").distinct().selectExpr("label", "order", "row_number() over (partition by label order by order) as n")
    cut = nth.where(F.col("n") <= rows_per_label).groupBy("label").agg(F.max("order").alias("cut")).collect()
    if not cut:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, np.float32), np.zeros(BUCKETS, bool), 0.5, 0.0, np.zeros((0, BUCKETS), np.float32), 0.0, 0.0)
    limits = F.create_map(*[F.lit(x) for r in cut for x in (r["label"], r["cut"])])

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = textnum.string_buffers(batch.column(1))
            keys, counts = [], []
            for i in range(batch.num_rows):
                h, _ = subwords(buf[off[i] : off[i + 1]], off[i : i + 2] - off[i])
                k, n = np.unique(h, return_counts=True)
                keys.append(k.astype(np.int32))
                counts.append(n.astype(np.int32))
            yield pa.record_batch(
                {"label": batch.column(0), "order": batch.column(2), "k": pa.array(keys, pa.list_(pa.int32())), "n": pa.array(counts, pa.list_(pa.int32()))}
            )

    sample = (
        labelled.where(F.col("order") <= F.try_element_at(limits, F.col("label"))).dropDuplicates(["label", "order"])
        .mapInArrow(bag, "label string, order long, k array<int>, n array<int>").toArrow()
    )
    sample = sample.sort_by([("order", "ascending"), ("label", "ascending")])
    labels = sorted(r["label"] for r in cut)
    y = np.array([labels.index(x) for x in sample["label"].to_pylist()])
    bags, sizes = [], []
    for k, n in zip(sample["k"], sample["n"]):
        n = n.values.to_numpy().astype(np.float32)
        sizes.append(n.sum())
        bags.append((k.values.to_numpy(), n / max(n.sum(), 1)))
    sizes = np.array(sizes)
    full = [i for i, b in enumerate(bags) if len(b[0])]
    held = np.array([i for i in full if i % round(1 / held_out) == 0], dtype=int)
    train = np.array([i for i in full if i % round(1 / held_out)], dtype=int)
    if not len(train):
        train = held
    e, w, bias, known = _train([bags[i] for i in train], y[train], len(labels), dim, epochs, rate, seed)
    z = np.array([w @ (bags[i][1] @ e[bags[i][0]]) + bias for i in held])
    seen = np.array([float(bags[i][1] @ known[bags[i][0]]) for i in held])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(probabilities(t)[np.arange(len(held)), y[held]] + 1e-12).mean())

    typical = np.full((len(labels), BUCKETS), 0.5)
    for i in train:
        typical[y[i], bags[i][0]] += bags[i][1] * sizes[i]
    typical = np.log(typical / typical.sum(axis=1, keepdims=True))
    fit_of = np.array([float(bags[i][1] @ typical[y[i], bags[i][0]]) for i in held])
    for c in range(len(labels)):
        typical[c] -= np.median(fit_of[y[held] == c]) if (y[held] == c).any() else np.median(fit_of)
    spread = np.array([float(bags[i][1] @ typical[y[i], bags[i][0]]) for i in held]) * scatter(sizes[held])

    temperature = min(np.geomspace(0.1, 10, 60), key=loss)
    p = probabilities(temperature)
    true = p[np.arange(len(held)), y[held]]
    return Model(
        labels, (w @ e.T / temperature).astype(np.float32), (bias / temperature).astype(np.float32), known,
        float(min(0.5, max(1.5 / len(labels), np.quantile(true, max_loss)))), float(0.5 * np.quantile(seen, max_loss)),
        typical.astype(np.float32), float(min(USUAL, SLACK * np.quantile(spread, max_loss))),
        float((p.argmax(axis=1) == y[held]).mean()),
    )


def scatter(size: np.ndarray) -> np.ndarray:
    return np.sqrt(np.minimum(size, FULL) / FULL)


def classify(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label number or -1, probability, accepted) of each row."""
    n, c = len(off) - 1, len(model.labels)
    best, prob, ok = np.full(n, -1), np.zeros(n), np.zeros(n, dtype=bool)
    if not c:
        return best, prob, ok
    table = np.concatenate([model.scores, model.known[None, :].astype(np.float32)])
    for lo, hi in textnum.slices(off, SLICE):
        h, r = subwords(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        m = hi - lo
        count = np.bincount(r, minlength=m)
        z = np.stack([np.bincount(r, weights=t[h], minlength=m) for t in table], axis=1) / np.maximum(count, 1)[:, None]
        seen, z = z[:, -1], z[:, :-1] + model.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        top = p.argmax(axis=1)
        has = count > 0
        fit_of = np.bincount(r, weights=model.typical[top[r], h], minlength=m) / np.maximum(count, 1) * scatter(count)
        best[lo:hi] = np.where(has, top, -1)
        prob[lo:hi] = np.where(has, p[np.arange(m), top], 0)
        ok[lo:hi] = has & (prob[lo:hi] >= model.least_probability) & (seen >= model.least_known) & (fit_of >= model.least_typical)
    return best, prob, ok


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, probability, accepted) of every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            best, prob, ok = classify(m, *textnum.string_buffers(batch.column(1)))
            names = [m.labels[i] if i >= 0 else None for i in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(prob), pa.array(ok)], names=["doc_id", "language", "probability", "accepted"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, language string, probability double, accepted boolean"
    )


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, whose text isn't rejected."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (text,) = free_names(docs.columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, ok = classify(shared.value, *textnum.string_buffers(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(ok))

    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, docs.schema)
