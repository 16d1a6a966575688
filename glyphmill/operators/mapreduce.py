"""User programs on records: mappers and reducers as Python functions or as executables that read and write lines."""

from __future__ import annotations

import itertools
import subprocess
import threading
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from glyphmill.functions.text import fnv1a_batch

Mapper = Callable[[Iterator[str]], Iterable[tuple[str, str]]]
Reducer = Callable[[str, Iterator[str]], Iterable[str]]
#: Makes fewer values of some of a key's values, of which a reducer makes the same lines.
Combiner = Callable[[str, Iterator[str]], Iterable[str]]
#: Different records that a task holds for its combiner, and their characters.
HELD_RECORDS, HELD_CHARS = 1 << 19, 32 << 20


def _batches(rows: Iterable[tuple], names: list[str], size: int = 10000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.string()) for i in range(len(names))], names=names)


def executable(command: list[str]) -> Callable[[Iterator[str]], Iterator[str]]:
    """Lines through a program; a return code other than 0 fails the task."""

    def run(lines: Iterator[str]) -> Iterator[str]:
        p = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)

        def feed() -> None:
            with p.stdin as to:
                to.writelines(line + "\n" for line in lines)

        feeder = threading.Thread(target=feed)
        feeder.start()
        yield from (line.rstrip("\n") for line in p.stdout)
        feeder.join()
        if p.wait():
            raise RuntimeError(f"{command[0]} ended with {p.returncode}")

    return run


def combined(records: Iterable[tuple[str, str]], combiner: Combiner) -> Iterator[tuple[str, str]]:
    """The records with fewer values for each key: equal ones are counted until the bounds are reached, then each key's values are combined and leave."""
    records, chars = iter(records), 0
    held: dict[str, Counter] = {}  # by value: most programs have few

    def flush() -> Iterator[tuple[str, str]]:
        if len(held) == 1:
            ((v, keys),) = held.items()
            for k, n in keys.items():
                for x in combiner(k, itertools.repeat(v, n)) if n > 1 else (v,):
                    yield k, x
            return
        values: dict[str, list[tuple[str, int]]] = {}
        for v, keys in held.items():
            for k, n in keys.items():
                values.setdefault(k, []).append((v, n))
        for k, vs in values.items():
            for x in combiner(k, itertools.chain.from_iterable(itertools.repeat(v, n) for v, n in vs)):
                yield k, x

    while part := list(itertools.islice(records, 10000)):
        by_value: dict[str, list[str]] = {}
        for k, v in part:
            if v in by_value:
                by_value[v].append(k)
            else:
                by_value[v] = [k]
        for v, keys in by_value.items():
            counts = held.setdefault(v, Counter())
            size = len(counts)
            counts.update(keys)
            chars += sum(map(len, itertools.islice(reversed(counts), len(counts) - size)))
        if sum(map(len, held.values())) + len(held) > HELD_RECORDS or chars + sum(map(len, held)) > HELD_CHARS:
            yield from flush()
            held, chars = {}, 0
    yield from flush()


def map_lines(lines: DataFrame, mapper: Mapper, column: str = "value", combiner: Combiner | None = None) -> DataFrame:
    """(key, value) records that a mapper makes of each partition's lines, combined in the task if there is a combiner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = mapper(x for b in batches for x in b.column(0).to_pylist() if x is not None)
        yield from _batches(records if combiner is None else combined(records, combiner), ["key", "value"])

    return lines.select(F.col(column).cast("string")).mapInArrow(run, "key string, value string")


def reduce_by_key(records: DataFrame, reducer: Reducer, reducers: int) -> DataFrame:
    """Output lines of a reducer that gets each key once, in the order of keys in its partition, with its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, v) for b in batches for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        lines = (line for key, group in itertools.groupby(rows, lambda r: r[0]) for line in reducer(key, (v for _, v in group)))
        yield from _batches(((line,) for line in lines), ["value"])

    part = F.pmod(F.arrow_udf(fnv1a_batch, LongType())("key"), F.lit(reducers))
    return records.select("key", "value").repartition(reducers, part).sortWithinPartitions("key").mapInArrow(run, "value string")


def map_reduce(lines: DataFrame, mapper: Mapper, reducer: Reducer, reducers: int = 8, combiner: Combiner | None = None) -> DataFrame:
    return reduce_by_key(map_lines(lines, mapper, combiner=combiner), reducer, reducers)


def word_count(texts: DataFrame, column: str = "text") -> DataFrame:
    """(word, n) of the words between white space, with partial sums before the shuffle."""
    from glyphmill.functions.text import white_tokens

    return texts.select(F.explode(white_tokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
