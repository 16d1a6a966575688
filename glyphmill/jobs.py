"""Jobs: a named list of tasks, run one after the other, as a mapping that can come from a JSON or YAML file."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import wikitext
from glyphmill.operators import index as I
from glyphmill.operators import mapreduce, search
from glyphmill.sources import pages as P


def reformat(spark: SparkSession, input: list[str], output: str, groups: int = 1, parts: int = 1, mode: str = "index", url_prefix: str = "", compression: str = "bzip2") -> None:
    """Wiki dumps to JSON lines in folders of group and part."""
    pages = P.wiki_pages(spark, input)
    table = wikitext.collect_templates(P.templates(pages)) if mode == "text" else None
    P.write_json_lines(P.ingest(P.articles(pages), groups=groups, mode=mode, templates=table, url_prefix=url_prefix), output, parts, compression)


def _documents(spark: SparkSession, input: str, s: I.Settings) -> DataFrame:
    """JSON lines in folders of group, as a corpus that keeps those groups."""
    lines = spark.read.option("recursiveFileLookup", "true").text(input).select("value", F.regexp_extract(F.input_file_name(), r"group_id=(\d+)", 1).alias("group"))
    docs = lines.select("group", F.from_json("value", P._DOC).alias("j")).where("j.metadata is not null")
    rows = docs.select(F.col("group").cast("int").alias("own"), "j.metadata.*", "j.doc")
    laid = I.corpus(rows, s, body="doc", title=F.coalesce("title", F.lit("")), url=F.coalesce("url", F.lit("")), group=F.col("own"))
    return laid


def build_index(spark: SparkSession, input: str, output: str, groups: int = 2, shards: int = 2, stems: bool = True) -> None:
    """JSON lines to a written index."""
    s = I.Settings(groups=groups, shards=shards, stems=stems)
    I.build(_documents(spark, input, s), s).write(output)


def answer(spark: SparkSession, index: str, queries: str, output: str, stems: bool = True) -> None:
    """A Parquet table (qid, q) to one of hits with their pages."""
    found = search.search(I.open_index(spark, index, I.Settings(stems=stems)), spark.read.parquet(queries))
    search.paginate(found).write.mode("overwrite").parquet(output)


def word_count(spark: SparkSession, input: str, output: str) -> None:
    mapreduce.word_count(spark.read.text(input), "value").write.mode("overwrite").parquet(output)


TASKS: dict[str, Callable[..., None]] = {"reformat": reformat, "index": build_index, "search": answer, "wordcount": word_count}


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def run_job(spark: SparkSession, spec: Mapping) -> bool:
    """Runs {"name": ..., "tasks": [{"spec": kind, ...arguments}, ...]}; the first task that fails ends it with its error."""
    tasks = list(spec.get("tasks") or [])
    if not spec.get("name") or not tasks:
        raise ValueError("a job has a name and at least one task")
    unknown = [t.get("spec") for t in tasks if t.get("spec") not in TASKS]
    if unknown:
        raise ValueError(f"unknown tasks {unknown}; there are {sorted(TASKS)}")
    for t in tasks:
        TASKS[t["spec"]](spark, **{k: v for k, v in t.items() if k != "spec"})
    return True
