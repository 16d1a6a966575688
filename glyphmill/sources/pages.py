"""Sources and sinks: wiki dumps, HTML pages, JSON lines, tab-separated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOC = "metadata struct<title: string, url: string, doc_id: bigint>, doc string"
_PAGE = "title string, ns string, id bigint, redirect struct<_title: string>, revision struct<id: bigint, text: string>"


def wiki_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(id, revid, title, ns, redirect, text) of the pages of XML dumps; .bz2 and .gz are unpacked."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(_PAGE).load(paths)
    return rows.select("id", F.col("revision.id").alias("revid"), "title", "ns", F.col("redirect").isNotNull().alias("redirect"), F.col("revision.text").alias("text"))


def _site(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    kind = "base string, namespaces struct<namespace: array<struct<_key: string, _VALUE: string>>>"
    return spark.read.format("xml").option("rowTag", "siteinfo").schema(kind).load(paths)


def site_namespaces(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, name) of the namespaces that a dump declares."""
    return _site(spark, paths).select(F.explode("namespaces.namespace").alias("n")).select(F.col("n._key").alias("key"), F.col("n._VALUE").alias("name"))


def site_base(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(base, url_prefix): the address of a dump's first page, and what precedes the titles in it."""
    return _site(spark, paths).select("base", F.regexp_extract("base", "^(.*/)[^/]*$", 1).alias("url_prefix"))


def articles(pages: DataFrame, *, disambiguation: bool = True) -> DataFrame:
    """Pages of namespace 0 without redirects, one for each id: that of the first revision.

    A dump lists the revisions of a page one after the other, so those are its
    adjacent repeats.  Without `disambiguation`, pages that carry a marker of
    disambiguation pages go too.
    """
    kept = pages.where("ns = '0' and not redirect")
    if not disambiguation:
        kept = kept.where(~F.coalesce(F.col("text").rlike(DISAMBIGUATION), F.lit(False)))
    names = kept.columns
    first = kept.groupBy("id").agg(F.min_by(F.struct(*names), F.col("revid")).alias("row"))
    return first.select(*[F.col("row").getField(n).alias(n) for n in names])


#: Templates and switches that mark a page of homonyms.
DISAMBIGUATION = r"(?i)\{\{\s*(disambig|disambiguation|dab|hndis|geodis|disambigua|homonymie|begriffsklärung)[^{}]*\}\}|__DISAMBIG__"


def templates(pages: DataFrame) -> DataFrame:
    """(title, text) of template and module pages; `wikitext.collect_templates` makes what the cleaner takes."""
    return pages.where("ns in ('10', '828')").select("title", "text")


def write_templates(pages: DataFrame, path: str) -> None:
    """Writes the templates as a table that later runs can read instead of the dump."""
    templates(pages).write.mode("overwrite").parquet(path)


def page_url_by_id(doc_id: Column, base: str) -> Column:
    """The address of a page by its number."""
    return F.format_string(base.replace("%", "%%") + "?curid=%d", doc_id)


def ingest(
    pages: DataFrame, *, groups: int = 1, order: str = "id", mode: str = "index", templates: dict[str, str] | None = None, url_prefix: str = "",
    least: int = 0,
) -> DataFrame:
    """(group_id, doc_id, title, url, doc) of wiki pages: project and template pages go, texts are cleaned, groups are dealt in turn.

    A text that is null or can't be cleaned is left out before numbers are
    given, so that it takes none.
    """
    from glyphmill.functions import text as X
    from glyphmill.functions import wikitext
    from glyphmill.operators.index import assign_groups

    cleaned = content_pages(pages).withColumn("doc", wikitext.clean_column("text", templates, mode=mode)).where(F.col("doc").isNotNull())
    dealt = assign_groups(long_enough(cleaned, "doc", least).select(order, "title", "doc"), order, groups)
    return dealt.select("group_id", F.col("local_id").alias("doc_id"), "title", X.page_url(F.col("title"), url_prefix).alias("url"), "doc")


def content_pages(pages: DataFrame) -> DataFrame:
    """Without pages whose title names a project or template page."""
    return pages.where(~F.col("title").contains("Wikipedia:") & ~F.col("title").contains("Template:"))


def long_enough(pages: DataFrame, column: str, least: int) -> DataFrame:
    return pages.where(F.length(column) >= least)


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, body) of HTML pages; body is the text between tags."""
    body = F.regexp_replace("html", r"(?s)<(script|style|title|nav)[^>]*>.*?</(script|style|title|nav)>", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]+>", " "), r"\s+", " "))
    return pages.select("page_id", "url", F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"), body.alias("body"))


def to_json_lines(docs: DataFrame) -> DataFrame:
    """(value) with {"metadata": {title, url, doc_id}, "doc"} for each document."""
    return docs.select(F.to_json(F.struct(F.struct("title", "url", "doc_id").alias("metadata"), "doc")).alias("value"))


def from_json_lines(lines: DataFrame) -> DataFrame:
    """Documents of JSON lines; lines that can't be read are left out."""
    return lines.select(F.from_json("value", _DOC).alias("j")).where("j.metadata is not null").select("j.metadata.*", "j.doc")


def read_json_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return from_json_lines(spark.read.text(paths, pathGlobFilter="*.in*"))


def write_json_lines(docs: DataFrame, path: str, parts: int, compression: str = "bzip2") -> None:
    """Folders of group and part (doc_id modulo the number of parts)."""
    value = F.to_json(F.struct(F.struct("title", "url", "doc_id").alias("metadata"), "doc"))
    docs.select("group_id", F.pmod("doc_id", F.lit(parts)).alias("part"), value.alias("value")).write.partitionBy("group_id", "part").option("compression", compression).text(path)


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, value) of tab-separated lines."""
    return spark.read.schema("key string, value string").option("sep", "\t").option("quote", "").csv(paths)


def write_records(rows: DataFrame, path: str, parts: int, compression: str | None = None) -> None:
    """(key, value) as tab-separated lines in `parts` files, each key whole in one and sorted there."""
    line = F.concat_ws("\t", F.col("key").cast("string"), F.col("value").cast("string")).alias("value")
    out = rows.repartition(parts, "key").sortWithinPartitions("key").select(line).write
    (out.option("compression", compression) if compression else out).text(path)


def write_extracted(docs: DataFrame, path: str, *, as_json: bool = False, rows_per_file: int = 0, bytes_per_file: int = 0, revid: str | None = None) -> None:
    """Documents as JSON, or between doc tags, in files of at most so many rows, or of about so many bytes.

    `revid` names a column that the JSON gets too.
    """
    xml = F.format_string('<doc id="%s" url="%s" title="%s">\n%s\n</doc>\n', "doc_id", "url", "title", "doc")
    more = [F.col(revid).alias("revid")] if revid else []
    value = F.to_json(F.struct(F.col("doc_id").alias("id"), "url", "title", F.col("doc").alias("text"), *more)) if as_json else xml
    lines = docs.select(value.alias("value"))
    if bytes_per_file:
        size, n = lines.agg(F.sum(F.octet_length("value") + 1), F.count("*")).first()
        rows_per_file = max(1, int(n * bytes_per_file / size)) if size else 0
    lines.write.option("maxRecordsPerFile", rows_per_file).text(path)
