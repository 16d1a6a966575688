"""Registered queries of the retrieval operators and their SQL.

DuckDB has no stemmer, so the queries with SQL run without stems; `search_ranked`
and `result_pages` have them and are tested by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions import wikitext
from glyphmill.operators import index as I
from glyphmill.operators import mapreduce, search, snippet
from glyphmill.sources import pages as P
from glyphmill.storage import bound_batches

Query = Callable[[SparkSession, str], DataFrame]
PLAIN = I.Settings(stems=False)
FULL = I.Settings()


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str, s: I.Settings = PLAIN) -> DataFrame:
    return I.corpus(_table(spark, sf, "documents"), s)


def _tf(spark: SparkSession, sf: str, s: I.Settings = PLAIN) -> DataFrame:
    return I.term_freq(_docs(spark, sf, s), s)


def _vocab(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    counts = I.doc_counts(docs)
    return I.vocabulary(I.group_df(I.inverted_df(I.inverted(docs, PLAIN)), counts, PLAIN), counts, PLAIN)


def _page_docs(spark: SparkSession, sf: str, s: I.Settings) -> DataFrame:
    pages = P.html_pages(_table(spark, sf, "pages"))
    return I.corpus(pages, s, doc_id="page_id", body="body", title=F.col("title"), url=F.col("url"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Query texts: the benchmark items."""
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def _hits(spark: SparkSession, sf: str, s: I.Settings) -> DataFrame:
    return search.search(I.build(_docs(spark, sf, s), s), _asked(spark, sf))


def _marked_up(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as wiki pages: bold, links of several kinds, templates, references, a heading, a table and entities around the text."""
    n = F.col("doc_id").cast("string")
    return _table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("'''Page "), n, F.lit("''' {{Infobox|a={{b|c}}|d}}is [[Target|shown "), n, F.lit("]]s, [[Plain]], [[File:x.png|thumb|[[a]] b]][http://e.org/"), n,
        F.lit(" site] &amp; {{uc:more}}<ref name=\"r\"/><ref>note</ref>\n== Heading ==\n{|\n| cell {{x}}\n|}"), F.col("text"), F.lit("\n\nend{{#if:|no|}}__TOC__"),
    ).alias("page"))


def wiki_clean(spark: SparkSession, sf: str) -> DataFrame:
    bound_batches(spark)
    return _marked_up(spark, sf).select("doc_id", wikitext.clean_column("page", mode="index").alias("clean"))


def parser_functions(spark: SparkSession, sf: str) -> DataFrame:
    call = F.concat(
        F.lit("{{uc:"), "lang", F.lit("}}|{{ucfirst:"), "lang", F.lit("}}|{{#ifeq:"), "lang", F.lit("|en|yes|no}}|{{#ifeq:"), "lang", F.lit("||yes|no}}|{{#if:{{lc: }}|a|b}}|{{#switch:"), "lang",
        F.lit("|en|de=germanic|fr=romance|#default=other}}|{{#expr:"), F.col("n_chars").cast("string"), F.lit("*2+1}}|{{#invoke:String|sublength|s="), "source", F.lit("|i=2|len=2}}|{{#invoke:String|find|"),
        "source", F.lit("|c}}|{{#iferror:{{#expr:1/0}}|bad|good}}|{{#invoke:Roman|main|"), (F.col("doc_id") % 4).cast("string"), F.lit("}}|{{unknown|x}}."),
    )
    rows = _table(spark, sf, "documents").select("doc_id", call.alias("call"))
    return rows.select("doc_id", wikitext.expand_column("call").alias("value"))


def best_sentence(spark: SparkSession, sf: str) -> DataFrame:
    index = I.build(_page_docs(spark, sf, PLAIN), PLAIN)
    asked = _asked(spark, sf)
    first = search.page_of(search.search(index, asked), 1).select("qid", "group_id", "doc_id")
    docs = index.docs.join(first, ["group_id", "doc_id"]).select("qid", "group_id", "doc_id", X.sentences(F.col("body")).alias("sents"))
    return snippet.best_sentences(index, asked, docs).select("qid", "doc_id", "sent_id")


def _r(c: str):
    return (F.rint(F.col(c) * 1e6) / 1e6).alias(c)


def ingest_pages(spark: SparkSession, sf: str) -> DataFrame:
    named = P.content_pages(P.html_pages(_table(spark, sf, "pages")))
    return named.select("page_id", "title", X.page_url(F.col("title"), "https://example.org/wiki/").alias("page_url"), X.title_length(F.col("title")).cast("long").alias("title_length"))


def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    lines = P.to_json_lines(docs.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("url"), F.col("text").alias("doc")))
    return P.from_json_lines(lines).select("doc_id", "title", "url", F.length("doc").cast("long").alias("n"))


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    index = I.build(_page_docs(spark, sf, FULL), FULL)
    asked = _asked(spark, sf)
    first = search.page_of(search.search(index, asked), 1)
    return snippet.result_page(index, asked, first)


def mapreduce_words(spark: SparkSession, sf: str) -> DataFrame:
    lines = _table(spark, sf, "documents").select(F.col("text").alias("value"))
    out = mapreduce.map_reduce(
        lines, lambda ls: ((w, "1") for x in ls for w in x.split(" ") if w), lambda k, vs: [f"{k}\x01{sum(map(int, vs))}"],
        combiner=lambda k, vs: [str(sum(map(int, vs)))],
    )
    parts = F.split("value", "\x01", -1)
    return out.select(parts[0].alias("word"), parts[1].cast("long").alias("n"))


QUERIES: dict[str, Query] = {
    "wordcount": lambda s, d: _table(s, d, "documents").select(F.explode(X.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
    "mapreduce_wordcount": mapreduce_words,
    "fnv_shard": lambda s, d: _docs(s, d).select("doc_id", "group_id", "shard"),
    "group_assign": lambda s, d: I.assign_groups(_table(s, d, "pages").select("page_id"), "page_id", 2),
    "ingest_pages": ingest_pages,
    "json_documents": json_documents,
    "stopword_filter": lambda s, d: _table(s, d, "documents").select("doc_id", F.array_join(X.without_stop_words(X.tokens(F.lower("text"))), " ").alias("terms")),
    "term_freq": lambda s, d: _tf(s, d).select("doc_id", "term", "tf"),
    "doc_count": lambda s, d: I.doc_counts(_docs(s, d)),
    "doc_freq_shard": lambda s, d: I.shard_df(_tf(s, d)),
    "doc_freq_group": lambda s, d: I.group_df(I.shard_df(_tf(s, d)), I.doc_counts(_docs(s, d)), PLAIN),
    "vocabulary": lambda s, d: _vocab(s, d).select("term", "term_id", "df", _r("idf")),
    "postings": lambda s, d: I.postings_string(I.merged_postings(I.inverted(_docs(s, d), PLAIN), PLAIN)),
    "doc_freq_global": lambda s, d: I.group_df(I.shard_df(_tf(s, d)), I.doc_counts(_docs(s, d)), PLAIN).groupBy("term").agg(F.sum("df").alias("df")),
    "doc_tfidf": lambda s, d: I.build(_docs(s, d), PLAIN).vectors.select("doc_id", "term", _r("weight")),
    "title_boost": lambda s, d: I.build(_page_docs(s, d, PLAIN), PLAIN).vectors.select("doc_id", "term", _r("weight")),
    "search_plain": lambda s, d: _hits(s, d, PLAIN).select("qid", "rank", "group_id", "doc_id", "score"),
    "search_paged": lambda s, d: search.page_of(_hits(s, d, PLAIN), 2).select("qid", "rank", "doc_id", "page", "num_results", "num_pages"),
    "search_ranked": lambda s, d: _hits(s, d, FULL),
    "result_pages": result_pages,
    "sentence_split": lambda s, d: _table(s, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_id", "sentence")),
    "highlight_prefixes": lambda s, d: _table(s, d, "benchmark").select("item_id", X.highlight_prefixes(X.html_escape(F.col("text")), ["the", "re", "ma"]).alias("marked")),
    "wiki_clean": wiki_clean,
    "parser_functions": parser_functions,
    "html_escape": lambda s, d: _table(s, d, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped")),
    "best_sentence": best_sentence,
    "token_spans": lambda s, d: _table(s, d, "benchmark").select("item_id", F.explode(X.token_spans(F.col("text"))).alias("t")).select("item_id", "t.token", F.expr("int(t.end - t.start)").alias("n"), F.col("t.start").alias("at")),
}

_TOK = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}')"
_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (xor(a, c) * 16777619) % 4294967296)"
_CTE = f"""
WITH docs AS (SELECT doc_id, (doc_id % 2)::INT AS group_id, ({_FNV} % 2)::INT AS shard, text, '' AS title FROM documents),
terms AS (SELECT group_id, shard, doc_id, unnest({_TOK.format("lower(text)")}) AS term FROM docs),
tf AS (SELECT group_id, shard, doc_id, term, count(*) AS tf FROM terms WHERE term NOT IN {_STOP} GROUP BY ALL),
n AS (SELECT group_id, count(*) AS n_docs FROM docs GROUP BY 1),
sdf AS (SELECT group_id, shard, term, count(*) AS df FROM tf GROUP BY ALL),
gdf AS (SELECT group_id, term, sum(df)::BIGINT AS df FROM sdf JOIN n USING (group_id) GROUP BY group_id, term, n_docs
        HAVING sum(df) > greatest(2, 1e-6 * n_docs) AND sum(df) < n_docs),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, ln((nn + 1) / (df + 1)) + 1 AS idf
          FROM (SELECT term, sum(df)::BIGINT AS df FROM gdf GROUP BY 1), (SELECT sum(n_docs)::BIGINT AS nn FROM n) WHERE df > 10 AND df < nn),
title AS (SELECT doc_id, unnest({_TOK.format("lower(title)")}) AS term, 1000 * pow(10 / len(string_split(title, ' ')), 2) AS w FROM docs WHERE title <> ''),
vec AS (SELECT doc_id, term, sum(w) * any_value(idf) AS weight FROM (SELECT doc_id, term, 1.0::DOUBLE AS w FROM terms UNION ALL SELECT * FROM title) JOIN vocab USING (term) GROUP BY ALL),
post AS (SELECT group_id, shard, term, list(struct_pack(doc_id := doc_id, tf := tf) ORDER BY nth) AS p
         FROM (SELECT *, row_number() OVER (PARTITION BY group_id, shard, term ORDER BY tf DESC, doc_id::VARCHAR) AS nth FROM tf) WHERE nth <= 100 GROUP BY ALL)"""
_TITLE = r"trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"
_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|title|nav)[^>]*>.*?</(script|style|title|nav)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_SEARCH = f"""{_CTE},
q AS (SELECT item_id AS qid, text AS q FROM benchmark),
qt AS (SELECT qid, unnest({_TOK.format("q")}) AS term, generate_subscripts({_TOK.format("q")}, 1) AS pos FROM q),
lists AS (SELECT qid, group_id, shard, list(list_transform(p, lambda x: x.doc_id) ORDER BY pos) AS l FROM qt JOIN post USING (term) GROUP BY ALL),
cand AS (SELECT qid, group_id, shard, unnest(list_reduce(l, lambda a, p: CASE WHEN len(a) = 0 THEN p ELSE list_intersect(a, p) END)) AS doc_id FROM lists),
qv AS (SELECT qid, term, count(*) * any_value(idf) AS qw FROM (SELECT qid, unnest({_TOK.format("lower(q)")}) AS term FROM q) JOIN vocab USING (term) GROUP BY ALL),
scored AS (SELECT qid, group_id, shard, doc_id, round_even(coalesce(sum(qw * weight), 0) * 100, 0) / 100 AS score
           FROM cand LEFT JOIN (SELECT qid, doc_id, qw * weight AS x, qw, weight FROM qv JOIN vec USING (term)) USING (qid, doc_id) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, group_id, shard, doc_id)::INT AS rank FROM scored QUALIFY rank <= 100)"""
_PAGES = _CTE.replace(f"FROM documents)", "FROM pg)").replace("WITH docs AS", f"WITH pg AS (SELECT page_id AS doc_id, {_BODY} AS text, {_TITLE} AS title FROM pages),\ndocs AS").replace("text, '' AS title", "text, title")
_SENTS = r"list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_BEST = f"""{_SEARCH.replace(_CTE, _PAGES)},
plain AS (SELECT DISTINCT qid, term, 2.0::DOUBLE AS factor FROM qt),
wt AS (SELECT qv.qid, qv.term, qw * idf * coalesce(factor, 1) AS x FROM qv JOIN vocab ON qv.term = vocab.term LEFT JOIN plain ON plain.qid = qv.qid AND plain.term = qv.term),
sents AS (SELECT qid, doc_id, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS sent_id
          FROM (SELECT qid, doc_id, list_slice({_SENTS.format("text")}, 1, 20) AS s FROM hits JOIN pg USING (doc_id) WHERE rank <= 10)),
st AS (SELECT qid, doc_id, sent_id, unnest({_TOK.format("lower(sent)")}) AS term FROM sents),
ss AS (SELECT qid, doc_id, sent_id, sum(x) * any_value(CASE WHEN sent_id = 0 THEN 3 ELSE 1 END) AS score FROM st JOIN wt USING (qid, term) GROUP BY qid, doc_id, sent_id),
best AS (SELECT qid, doc_id, sent_id FROM ss QUALIFY row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, sent_id) = 1)
SELECT qid, doc_id, coalesce(sent_id, 0)::INT AS sent_id FROM hits LEFT JOIN best USING (qid, doc_id) WHERE rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "wordcount": f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOK.format('text')}) AS word FROM documents) GROUP BY 1",
    "mapreduce_wordcount": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1",
    "fnv_shard": f"{_CTE} SELECT doc_id, group_id, shard FROM docs",
    "group_assign": "SELECT page_id, ((row_number() OVER (ORDER BY page_id) - 1) % 2)::INT AS group_id, (row_number() OVER (ORDER BY page_id) - 1) // 2 AS local_id FROM pages",
    "ingest_pages": f"SELECT page_id, title, 'https://example.org/wiki/' || replace(title, ' ', '_') AS page_url, len(string_split(title, ' '))::BIGINT AS title_length FROM (SELECT page_id, {_TITLE} AS title FROM pages) WHERE title NOT LIKE '%Wikipedia:%' AND title NOT LIKE '%Template:%'",
    "json_documents": "SELECT doc_id, source AS title, lang AS url, length(text) AS n FROM documents",
    "stopword_filter": f"SELECT doc_id, array_to_string(list_filter({_TOK.format('lower(text)')}, lambda t: t NOT IN {_STOP}), ' ') AS terms FROM documents",
    "term_freq": f"{_CTE} SELECT doc_id, term, tf FROM tf",
    "doc_count": f"{_CTE} SELECT * FROM n",
    "doc_freq_shard": f"{_CTE} SELECT * FROM sdf",
    "doc_freq_group": f"{_CTE} SELECT * FROM gdf",
    "vocabulary": f"{_CTE} SELECT term, term_id, df, round_even(idf, 6) AS idf FROM vocab",
    "postings": f"{_CTE} SELECT group_id, shard, term, array_to_string(list_transform(p, lambda x: x.doc_id || ':' || x.tf), ',') AS line FROM post",
    "doc_tfidf": f"{_CTE} SELECT doc_id, term, round_even(weight, 6) AS weight FROM vec",
    "title_boost": f"{_PAGES} SELECT doc_id, term, round_even(weight, 6) AS weight FROM vec",
    "search_plain": f"{_SEARCH} SELECT qid, rank, group_id, doc_id, score FROM hits",
    "search_paged": f"{_SEARCH} SELECT qid, rank, doc_id, (rank - 1) // 10 + 1 AS page, n AS num_results, ceil(n / 10)::BIGINT AS num_pages FROM hits JOIN (SELECT qid, count(*) AS n FROM hits GROUP BY 1) USING (qid) WHERE (rank - 1) // 10 = 1",
    "sentence_split": r"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS sent_id, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)",
    "highlight_prefixes": r"SELECT item_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(^|[^\p{L}\p{N}_])((the|re|ma)[\p{L}\p{N}_]*)', '\1<strong>\2</strong>', 'g') AS marked FROM benchmark",
    "doc_freq_global": f"{_CTE} SELECT term, sum(df)::BIGINT AS df FROM gdf GROUP BY 1",
    "html_escape": "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages",
    "wiki_clean": """SELECT doc_id, replace('Page ' || doc_id || ' is shown ' || doc_id || 's, Plain, site & MORE' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'end', chr(10) || chr(10), '') AS clean FROM documents""",
    "parser_functions": """SELECT doc_id, upper(lang) || '|' || upper(lang[1]) || lang[2:] || '|' || (CASE WHEN lang = 'en' THEN 'yes' ELSE 'no' END) || '||b|' ||
        (CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang = 'fr' THEN 'romance' ELSE 'other' END) || '|' || (n_chars * 2 + 1) || '|' || substr(source, 2, 2) || '|' ||
        strpos(source, 'c') || '|bad|' || ['', 'I', 'II', 'III'][(doc_id % 4 + 1)::INT] || '|.' AS value FROM documents""",
    "best_sentence": _BEST,
    "token_spans": f"""SELECT item_id, token, len(token)::INT AS n, (len(array_to_string(before, '')) + coalesce(list_sum(list_transform(done, lambda x: len(x))), 0))::INT AS at FROM (
        SELECT item_id, toks[i] AS token, gaps[1:i] AS before, toks[1:i - 1] AS done FROM (
        SELECT item_id, toks, gaps, unnest(range(1, len(toks) + 1)) AS i FROM (
        SELECT item_id, {_TOK.format("text")} AS toks, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS gaps FROM benchmark)))""",
}
