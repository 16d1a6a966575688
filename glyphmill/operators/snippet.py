"""Result pages: the best sentence of each hit, widened and highlighted."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions.porter2 import stem
from glyphmill.operators.index import Index, Settings
from glyphmill.storage import Workspace

_WORD = re.compile(r"\b\w\w+\b")


def best_sentences(index: Index, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the documents (qid, group_id, doc_id, sents) of the hits: (qid, group_id, doc_id, sent_id): first of the sentences with the highest score; sentence 0 if none has one."""
    s = index.settings
    q = queries.select("qid", F.explode(X.analyse(F.lower("q"), stems=s.stems)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("n"))
    plain = queries.select("qid", F.explode(F.array_distinct(X.tokens(F.col("q")))).alias("term"), F.lit(s.verbatim_term).alias("factor"))
    weights = index.vocab.join(q, "term").join(plain, ["qid", "term"], "left").select(
        "qid", "term", (F.col("n") * F.col("idf") * F.col("idf") * F.coalesce("factor", F.lit(1.0))).alias("w")
    )
    sents = docs.select("qid", "group_id", "doc_id", F.posexplode(F.slice("sents", 1, s.snippet_sentences)).alias("sent_id", "sent"))
    terms = sents.select("qid", "group_id", "doc_id", "sent_id", F.posexplode(X.analyse(F.lower("sent"), stems=s.stems)).alias("pos", "term"))
    # added in the order of the tokens: another order gives another last bit, which decides between sentences of the same tokens
    added = F.aggregate(F.sort_array(F.collect_list(F.struct("pos", "w"))), F.lit(0.0), lambda a, x: a + x["w"])
    score = added * F.when(F.col("sent_id") == 0, F.lit(s.first_sentence)).otherwise(F.lit(1.0))
    scored = terms.join(weights, ["qid", "term"]).groupBy("qid", "group_id", "doc_id", "sent_id").agg(score.alias("score"))
    best = scored.groupBy("qid", "group_id", "doc_id").agg(F.max_by("sent_id", F.struct(F.col("score"), -F.col("sent_id"))).alias("sent_id"))
    return docs.select("qid", "group_id", "doc_id").join(best, ["qid", "group_id", "doc_id"], "left").select(
        "qid", "group_id", "doc_id", F.coalesce("sent_id", F.lit(0)).alias("sent_id")
    )


def expand(sents: list[str], at: int, terms: set[str], n: int = 80) -> str:
    """The sentence with as much of what follows as makes n words."""
    words: list[str] = []
    used = 0
    for sent in sents[at:]:
        words += sent.split()
        used += 1
        if len(words) >= n:
            break
    if len(words) > n:
        if used > 1:
            words = words[:n]
        else:
            p = max((i for i, w in enumerate(words) if w in terms), default=0)
            half = n // 2
            words = words[-n:] if len(words) - p < half else words[:n] if p < half else words[p - half : p + half]
            words.insert(0, "... ")
    return " ".join(words) + " ..."


def highlight(snippet: str, terms: set[str]) -> str:
    """Escapes the snippet and marks the words whose stem is asked for."""
    out, last = [], 0
    for m in _WORD.finditer(snippet):
        if stem(m[0]) in terms:
            out += [html.escape(snippet[last : m.start()], quote=False), "<strong>", html.escape(m[0], quote=False), "</strong>"]
            last = m.end()
    return "".join(out) + html.escape(snippet[last:], quote=False)


def _snippets(n: int):
    @F.arrow_udf("string")
    def run(sents: pa.Array, at: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for s, i, t in zip(sents.to_pylist(), at.to_pylist(), terms.to_pylist()):
            asked = set(t or ())
            out.append(highlight(expand(s, i, asked, n), asked) if s else "")
        return pa.array(out, pa.string())

    return run


def result_page(index: Index, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """`hits` with title, url and snippet, keyed by group and document.

    Only the documents of the hits are read in full, once.
    """
    ws = Workspace(hits.sparkSession, "snippets")
    hits = ws.save(hits, "hits")
    docs = index.docs.select("group_id", "doc_id", "title", "url", X.sentences(F.col("body")).alias("sents"))
    rows = ws.save(docs.join(hits, ["group_id", "doc_id"]), "documents")
    best = best_sentences(index, queries, rows)
    terms = queries.select("qid", X.analyse(F.col("q"), stems=True).alias("terms"))
    out = rows.join(best, ["qid", "group_id", "doc_id"]).join(terms, "qid")
    snippet = _snippets(index.settings.snippet_tokens)("sents", "sent_id", "terms")
    return out.withColumn("snippet", snippet).select(*hits.columns, "title", "url", "snippet")


def document_snippet(body: str, query: str, idf: dict[str, float], s: Settings = Settings()) -> str:
    """The snippet of one document, without a session: `idf` has the vocabulary's terms of the query."""
    sents = [x for x in re.sub(r"([.!?])\s+", "\\1\x01", body).split("\x01") if x]
    if not sents:
        return ""
    asked, plain = Counter(_analyse(query.lower())), set(_WORD.findall(query))
    weight = {t: n * idf[t] * idf[t] * (s.verbatim_term if t in plain else 1.0) for t, n in asked.items() if t in idf}
    score = [sum(weight.get(t, 0.0) for t in _analyse(x.lower())) for x in sents[: s.snippet_sentences]]
    score[0] *= s.first_sentence
    terms = set(_analyse(query))
    return highlight(expand(sents, max(range(len(score)), key=lambda i: (score[i], -i)), terms, s.snippet_tokens), terms)


def _analyse(text: str) -> list[str]:
    return [t for w in _WORD.findall(text) for t in dict.fromkeys((w, stem(w)))]
