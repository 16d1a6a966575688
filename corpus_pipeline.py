"""A training-corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents; the last returns doc_id, lang, source, n_chars,
token_ids, n_tokens and round_trip.

Defined results
---------------
* A null or empty text has no language, so the first stage rejects it; the later
  stages pass such rows, but for mixing, where they hold no tokens.
* A null doc_id stays; its row takes no part in line dedup and near-dedup.
* Repeated rows: line dedup treats rows that agree in doc_id and text alike,
  near-dedup keeps one of them.
* Ties between near-copies: the least doc_id stays.
* Very long texts are read whole in every stage.
* Further columns pass through all stages but the last, whatever their names.
* Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, langid, line_dedup, mixing, near_dedup
from glyphmill.llm.common import Workspace, free_names


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents of which nothing is left; n_chars follows the text."""
    (gone,) = free_names(docs.columns, "lines_gone")
    out = line_dedup.drop_repeated_lines(docs, count=gone)
    left = out.where((F.col(gone) == 0) | F.col("text").rlike(r"\S"))
    changed = F.col(gone) > 0
    cols = [F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*cols)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the blocks drawn by the target weights of the sources; a document that is drawn again comes again."""
    return mixing.mix_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed texts, and whether decoding them gives back the text."""
    return bpe.encode(docs, keep=["doc_id", "lang", "source", "n_chars"], verify=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_text),
]

#: SQL can't express the trained classifier, the pseudorandom draw or the BPE merges; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as a table in the shared folder before the next reads it."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
