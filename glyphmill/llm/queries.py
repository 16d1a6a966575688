"""Registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import bpe, embedding_dedup, langid, line_dedup, media, mixing, near_dedup, sharding, suffix_dedup, token_counts


SHARDS, APPENDED = 256, 32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_media(_table(spark, sf_dir, "pages"), "html")[0]


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), keep=["doc_id"], verify=True)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), ["doc_id"], SHARDS, appended=APPENDED)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, count="lines_removed")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_blocks(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_media_columns": op3_media_columns,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}

#: The jump sequence of every key, step by step; the last step before the number of shards is the shard.
_JUMP = """
  {name}(doc_id, k, b, j) AS (
    SELECT doc_id, key, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM keys
    UNION ALL
    SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616, j,
           CAST(floor((j + 1) * (2147483648.0::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592)::DOUBLE + 1.0::DOUBLE))) AS BIGINT)
    FROM {name} WHERE j < {shards}
  )"""

ORACLE_SQL: dict[str, str] = {
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings
  ), near AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) >= 0.95 * a.norm * b.norm
  ), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, n.b FROM reach r JOIN near n ON n.a = r.other
  )
SELECT vec_id, min(other) AS group_id, min(other) = vec_id AS kept FROM reach GROUP BY vec_id
""",
    "op7_sharding": f"""
WITH RECURSIVE keys AS (
    SELECT DISTINCT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT::UHUGEINT AS key FROM documents
  ),{_JUMP.format(name="before", shards=SHARDS)},{_JUMP.format(name="after", shards=SHARDS + APPENDED)}
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(x.b AS INT) AS shard, CAST(y.b AS INT) AS shard_after, x.b <> y.b AS moved
FROM documents d
JOIN (SELECT doc_id, max(b) AS b FROM before GROUP BY doc_id) x USING (doc_id)
JOIN (SELECT doc_id, max(b) AS b FROM after GROUP BY doc_id) y USING (doc_id)
""",
}
