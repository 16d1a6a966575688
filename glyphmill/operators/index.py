"""Building the index: corpus layout, term frequencies, postings, vocabulary and document vectors.

A corpus row is (group_id, shard, doc_id, title, url, body).  Frequencies are
aggregated before anything is shuffled; documents, not tokens, are the unit
that the first stage handles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glyphmill.functions import text as X
from glyphmill.functions.porter2 import stem
from glyphmill.storage import Workspace, numbered

KEY = ["group_id", "shard", "doc_id"]


@dataclass(frozen=True)
class Settings:
    """Constants of the index and of the search."""

    groups: int = 2
    shards: int = 2
    stems: bool = True
    postings_cap: int = 100
    group_df_above: int = 2
    group_df_share: float = 1e-6
    global_df_above: int = 10
    title_bonus: float = 1000.0
    blur_weight: float = 0.2
    hits: int = 100
    page_size: int = 10
    snippet_sentences: int = 20
    first_sentence: float = 3.0
    verbatim_term: float = 2.0
    snippet_tokens: int = 80

    def __post_init__(self) -> None:
        for name in ("groups", "shards", "postings_cap", "hits", "page_size", "snippet_sentences", "snippet_tokens"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 <= self.blur_weight <= 1:
            raise ValueError("blur_weight must lie between 0 and 1")


def corpus(docs: DataFrame, s: Settings, *, doc_id: str = "doc_id", body: str = "text", title: Column | None = None, url: Column | None = None, group: Column | None = None) -> DataFrame:
    """Lays documents out in groups, by their number if `group` doesn't tell, and shards."""
    key = F.col(doc_id).cast("long")
    return docs.select(
        (F.pmod(key, F.lit(s.groups)).cast("int") if group is None else group).alias("group_id"), F.pmod(X.fnv1a(key.cast("string")), F.lit(s.shards)).cast("int").alias("shard"),
        key.alias("doc_id"), (F.lit("") if title is None else title).alias("title"), (F.lit("") if url is None else url).alias("url"),
        F.col(body).alias("body"),
    ).where("doc_id is not null and body is not null")


def assign_groups(pages: DataFrame, order: str, groups: int) -> DataFrame:
    """Deals rows to groups in turn, in the given order, and numbers them within each group, from 0."""
    rows = numbered(pages, order, "gm_row")
    n = F.col("gm_row")
    return rows.withColumn("group_id", F.pmod(n, F.lit(groups)).cast("int")).withColumn("local_id", F.floor(n / groups).cast("long")).drop("gm_row")


def term_freq(docs: DataFrame, s: Settings) -> DataFrame:
    """(group_id, shard, doc_id, term, tf) of the lower-cased body, without stop words."""
    terms = X.without_stop_words(X.analyse(F.lower("body"), stems=s.stems))
    return docs.select(*KEY, F.explode(terms).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))


def _invert(stems: bool):
    """The rows of `inverted` of batches of (group_id, shard, doc_id, tokens) with one row for each document."""
    stop = pa.array(X.STOP_WORDS)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        group, shard, doc = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        n, lists = b.num_rows, b.column(3)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if stems:
            words = names.to_pylist()
            both = pa.array(words + [stem(w) for w in words], pa.string()).dictionary_encode()
            names, to = both.dictionary, both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            word, root = to[: len(words)][code], to[len(words) :][code]
            other = word != root
            row, code = np.concatenate([row, row[other]]), np.concatenate([word, root[other]])
        keep = ~pc.is_in(names, value_set=stop).to_numpy(zero_copy_only=False)[code]
        places, place = np.unique(np.stack([group, shard], axis=1), axis=0, return_inverse=True)
        place = place.reshape(-1)
        found, tf = np.unique((code[keep] * len(places) + place[row[keep]]) * n + row[keep], return_counts=True)
        block, row = found // n, found % n
        # within a term of a shard: most frequent first, ties by doc_id as a string
        order = np.lexsort((np.argsort(np.argsort(doc.astype("U20"), kind="stable"), kind="stable")[row], -tf, block))
        block, ids, tf = block[order], doc[row[order]], tf[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        offsets = pa.array(np.append(starts, len(block)).astype(np.int32))
        where = places[block[starts] % len(places)].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(where[:, 0]), pa.array(where[:, 1]), names.take(pa.array(block[starts] // len(places))), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(tf))],
            names=["group_id", "shard", "term", "ids", "tfs"],
        )

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = rows(b)
                yield from (out.slice(at, 50_000) for at in range(0, out.num_rows, 50_000))

    return run


def inverted(docs: DataFrame, s: Settings) -> DataFrame:
    """(group_id, shard, term, ids, tfs): the frequencies of `term_freq`, one row for each term of a shard in each batch of documents.

    Nothing is shuffled but the rows of documents that have several.
    """
    rows = docs.select(*KEY, X.tokens(F.lower("body")).alias("tokens"))
    again = docs.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    if not again.isEmpty():
        merged = rows.join(again, KEY, "left_semi").groupBy(*KEY).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
        rows = rows.join(again, KEY, "left_anti").unionByName(merged)
    return rows.mapInArrow(_invert(s.stems), "group_id int, shard int, term string, ids array<bigint>, tfs array<bigint>")


def inverted_df(blocks: DataFrame) -> DataFrame:
    """`shard_df` of inverted rows."""
    return blocks.groupBy("group_id", "shard", "term").agg(F.sum(F.size("ids").cast("long")).alias("df"))


def merged_postings(blocks: DataFrame, s: Settings) -> DataFrame:
    """`postings` of inverted rows: each one's first documents, as many as the cap, are merged."""
    heads = blocks.select("group_id", "shard", "term", F.slice(F.arrays_zip("ids", "tfs"), 1, s.postings_cap).alias("p"))
    entry = lambda x: F.struct((-x["tfs"]).alias("less"), x["ids"].cast("string").alias("name"), x["ids"].alias("doc_id"), x["tfs"].alias("tf"))
    rows = heads.groupBy("group_id", "shard", "term").agg(F.collect_list("p").alias("p"))
    flat = F.flatten("p")
    first = F.when(F.size("p") == 1, F.transform(flat, entry)).otherwise(F.slice(F.sort_array(F.transform(flat, entry)), 1, s.postings_cap))
    return rows.select("group_id", "shard", "term", F.transform(first, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["tf"].alias("tf"))).alias("postings"))


def doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("group_id").agg(F.count("*").alias("n_docs"))


def postings(tf: DataFrame, s: Settings) -> DataFrame:
    """(group_id, shard, term, postings) with at most the cap of documents, most frequent first, ties by doc_id as a string."""
    nth = Window.partitionBy("group_id", "shard", "term").orderBy(F.desc("tf"), F.col("doc_id").cast("string"))
    top = tf.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= s.postings_cap)
    rows = top.groupBy("group_id", "shard", "term").agg(F.sort_array(F.collect_list(F.struct("nth", "doc_id", "tf"))).alias("p"))
    return rows.select("group_id", "shard", "term", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["tf"].alias("tf"))).alias("postings"))


def postings_string(post: DataFrame) -> DataFrame:
    """Postings as `doc:tf` parts joined by commas."""
    return post.select("group_id", "shard", "term", F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["doc_id"], x["tf"])), ",").alias("line"))


def shard_df(tf: DataFrame) -> DataFrame:
    """Document frequencies, counted before postings are capped."""
    return tf.groupBy("group_id", "shard", "term").agg(F.count("*").alias("df"))


def group_df(by_shard: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """Frequencies of each group that lie strictly between its bounds."""
    df = by_shard.groupBy("group_id", "term").agg(F.sum("df").alias("df")).join(counts, "group_id")
    return df.where((F.col("df") > F.greatest(F.lit(float(s.group_df_above)), F.col("n_docs") * s.group_df_share)) & (F.col("df") < F.col("n_docs"))).select("group_id", "term", "df")


@F.arrow_udf(DoubleType())
def idf(n: pa.Array, df: pa.Array) -> pa.Array:
    """Smoothed inverse document frequency; the JVM's logarithm differs from the C library's, which SQL has, in the last bit of some values."""
    return pa.array([math.log((a + 1) / (b + 1)) + 1 for a, b in zip(n.to_pylist(), df.to_pylist())], pa.float64())


def vocabulary(by_group: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """(term, term_id, df, idf) over all groups; ids are dense in the order of terms.

    Ids come from row numbers within the first two characters and the sum of
    the earlier ones' sizes, so no step sorts the vocabulary in one task.
    """
    total = counts.agg(F.sum("n_docs").alias("n"))
    df = by_group.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") > s.global_df_above).crossJoin(F.broadcast(total)).where("df < n")
    rows = df.select("term", "df", idf("n", "df").alias("idf"), F.substring("term", 1, 2).alias("head"))
    rows = Workspace(rows.sparkSession, "vocabulary").save(rows, "terms")  # read twice
    sizes = rows.groupBy("head").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("head").orderBy("term"))).join(sizes.withColumn("before", before), "head")
    return numbered.select("term", (F.col("before") + F.col("nth") - 1).cast("long").alias("term_id"), "df", "idf")


def title_freq(docs: DataFrame, s: Settings) -> DataFrame:
    """(group_id, shard, doc_id, term, w): each title term's damped and boosted frequency."""
    boost = F.lit(s.title_bonus) * F.pow(F.lit(10.0) / X.title_length(F.col("title")), F.lit(2.0))
    terms = docs.where("title <> ''").select(*KEY, F.explode(X.analyse(F.lower("title"), stems=s.stems)).alias("term"), boost.alias("boost"))
    return terms.groupBy(*KEY, "term").agg(F.sum("boost").alias("w"))


def doc_vectors(blocks: DataFrame, titles: DataFrame | None, vocab: DataFrame) -> DataFrame:
    """(group_id, shard, doc_id, term, weight): idf times body frequency, of inverted rows, plus that of the title.

    The vocabulary has no stop words, so the frequencies without them will do.
    """
    known = blocks.join(vocab.select("term", "idf"), "term")
    body = known.select("group_id", "shard", "term", "idf", F.explode(F.arrays_zip("ids", "tfs")).alias("e"))
    body = body.select("group_id", "shard", F.col("e.ids").alias("doc_id"), "term", F.col("e.tfs").cast("double").alias("w"), "idf")
    if titles is None:  # a document has a term once
        return body.select(*KEY, "term", (F.col("w") * F.col("idf")).alias("weight"))
    both = body.unionByName(titles.join(vocab.select("term", "idf"), "term"))
    return both.groupBy(*KEY, "term").agg((F.sum("w") * F.first("idf")).alias("weight"))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    vectors: DataFrame
    settings: Settings
    blocks: DataFrame | None = None
    titles: DataFrame | None = None

    def vectors_of(self, terms: DataFrame) -> DataFrame:
        """The rows of `vectors` that have one of the terms (term); of an index just built, only those are made."""
        if self.blocks is None:
            return self.vectors.join(terms, "term", "left_semi")
        asked = self.vocab.join(terms, "term", "left_semi")
        return doc_vectors(self.blocks, self.titles, asked)

    def write(self, path: str) -> None:
        """Writes the tables as Parquet; documents and postings lie in folders of group and shard."""
        for name in ("docs", "postings", "vectors"):
            getattr(self, name).write.partitionBy("group_id", "shard").mode("overwrite").parquet(f"{path}/{name}")
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def build(docs: DataFrame, s: Settings = Settings()) -> Index:
    """All tables of the index of a corpus.

    Documents are tokenised once: the frequencies are a written table, and the
    other tables are made of it; the vectors when they are read.
    """
    ws = Workspace(docs.sparkSession, "index")
    blocks = ws.save(inverted(docs, s), "inverted")
    counts = doc_counts(docs)
    vocab = ws.save(vocabulary(group_df(inverted_df(blocks), counts, s), counts, s), "vocab")
    post = ws.save(merged_postings(blocks, s), "postings")
    titles = ws.save(title_freq(docs, s), "titles")
    if titles.isEmpty():
        titles = None
    return Index(docs, post, vocab, doc_vectors(blocks, titles, vocab), s, blocks, titles)


def open_index(spark, path: str, s: Settings = Settings()) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{n}") for n in ("docs", "postings", "vocab", "vectors")], s)


def idf_of(index: Index, term: str) -> DataFrame:
    return index.vocab.where(F.col("term") == term).select("term", "idf")
