"""Ranked retrieval for a table of queries (qid, q): one plan for all of them.

Candidates come from the capped postings, folded in the order of the query's
tokens: unknown tokens are passed over, and an empty intersection starts anew
with the next token's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.operators.index import Index
from glyphmill.storage import Workspace

WHERE = ["qid", "group_id", "shard"]


def fold(lists: Column) -> Column:
    """Intersection of (pos, ids) lists in the order of pos, which starts anew where it is empty."""
    ids = F.transform(F.sort_array(lists), lambda x: x["ids"])
    return F.aggregate(ids, F.array().cast("array<bigint>"), lambda a, p: F.when(F.size(a) == 0, p).otherwise(F.array_intersect(a, p)))


def candidates(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, group_id, shard, doc_id, phase): 0 for matches of the tokens as they are, 1 for those only found through stems."""
    exact = queries.select("qid", F.lit(0).alias("phase"), F.posexplode(X.tokens(F.col("q"))).alias("pos", "term"))
    loose = queries.select("qid", F.lit(1).alias("phase"), F.posexplode(X.analyse(F.col("q"), stems=index.settings.stems)).alias("pos", "term"))
    wanted = exact.unionByName(loose)
    ids = F.transform("postings", lambda x: x["doc_id"])
    found = index.postings.join(wanted, "term").select(*WHERE, "phase", F.struct("pos", ids.alias("ids")).alias("l"))
    folded = found.groupBy(*WHERE).agg(*[fold(F.collect_list(F.when(F.col("phase") == p, F.col("l")))).alias(f"p{p}") for p in (0, 1)])
    both = F.concat(
        F.transform("p0", lambda d: F.struct(d.alias("doc_id"), F.lit(0).alias("phase"))),
        F.transform(F.array_except("p1", "p0"), lambda d: F.struct(d.alias("doc_id"), F.lit(1).alias("phase"))),
    )
    return folded.select(*WHERE, F.explode(both).alias("c")).select(*WHERE, "c.doc_id", "c.phase")


def query_vectors(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, qw): idf times the term's count in the lower-cased query."""
    terms = queries.select("qid", F.explode(X.analyse(F.lower("q"), stems=index.settings.stems)).alias("term"))
    counts = terms.groupBy("qid", "term").agg(F.count("*").alias("n"))
    return index.vocab.join(counts, "term").select("qid", "term", (F.col("n") * F.col("idf")).alias("qw"))


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, rank, group_id, shard, doc_id, phase, score) of the best hits of each query.

    Ties: group, shard, phase, doc_id.
    """
    s = index.settings
    found = Workspace(queries.sparkSession, "search").save(candidates(index, queries), "candidates")
    # the vectors are made for the few terms that are asked for, then meet the candidates
    asked = query_vectors(index, queries)
    weights = index.vectors_of(asked.select("term").distinct()).select("group_id", "doc_id", "term", "weight")
    dots = (
        weights.join(asked, "term").join(found.select("qid", "group_id", "doc_id"), ["qid", "group_id", "doc_id"])
        .groupBy("qid", "group_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("dot"))
    )
    factor = F.when(F.col("phase") == 0, F.lit(1.0)).otherwise(F.lit(s.blur_weight))
    scored = found.join(dots, ["qid", "group_id", "doc_id"], "left").withColumn("score", X.round2(factor * F.coalesce("dot", F.lit(0.0))))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "group_id", "shard", "phase", "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= s.hits).select("qid", "rank", "group_id", "shard", "doc_id", "phase", "score")


def paginate(hits: DataFrame, page_size: int = 10) -> DataFrame:
    """Adds the page of each hit, from 1, and the numbers of results and pages of its query."""
    n = F.count("*").over(Window.partitionBy("qid"))
    return hits.withColumns({"page": F.floor((F.col("rank") - 1) / page_size) + 1, "num_results": n, "num_pages": F.ceil(n / page_size)})


def page_of(hits: DataFrame, page: int, page_size: int = 10) -> DataFrame:
    """One page of every query; out of range, it has no rows."""
    return paginate(hits, page_size).where(F.col("page") == page)
