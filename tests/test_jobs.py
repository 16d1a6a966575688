"""Map/reduce programs and jobs from a dump to hits."""

import json
from collections import Counter

import pytest

from glyphmill import jobs
from glyphmill.operators import mapreduce

LINES = ["abc fish fish", "", "abc", None, "dog  fish"]


def test_programs_as_functions_and_executables(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string").repartition(3)
    want = Counter(w for x in LINES if x for w in x.split())
    out = mapreduce.map_reduce(lines, lambda ls: ((w, "1") for x in ls for w in x.split()), lambda k, vs: [f"{k} {sum(map(int, vs))}"], 3)
    assert sorted(r[0] for r in out.collect()) == sorted(f"{k} {n}" for k, n in want.items())
    upper = mapreduce.executable(["tr", "a-z", "A-Z"])
    loud = mapreduce.map_lines(lines, lambda ls: ((x, "1") for x in upper(ls)))
    assert sorted(r["key"] for r in loud.collect()) == sorted(x.upper() for x in LINES if x is not None)
    assert {r["word"]: r["n"] for r in mapreduce.word_count(lines, "value").collect()} == want


def test_combined_records_travel_once_a_key_and_task(spark, monkeypatch):
    lines = spark.createDataFrame([(f"{'ab' * (i % 7)} x\U00010348 é {i}",) for i in range(3000)] + [(None,), ("",)], "value string").coalesce(2)
    mapper, total = lambda ls: ((w, "1") for x in ls for w in x.split(" ") if w), lambda k, vs: [str(sum(map(int, vs)))]
    want = Counter(w for r in lines.collect() if r[0] for w in r[0].split(" ") if w)
    records = mapreduce.map_lines(lines, mapper, combiner=total)
    assert records.count() <= 2 * len(want) and Counter({k: n for k, n in want.items() if n > 9}).keys() >= {"x\U00010348"}
    out = mapreduce.map_reduce(lines, mapper, lambda k, vs: [f"{k} {sum(map(int, vs))}"], 3, combiner=total)
    assert sorted(r[0] for r in out.collect()) == sorted(f"{k} {n}" for k, n in want.items())
    monkeypatch.setattr(mapreduce, "HELD_RECORDS", 5)
    few = list(mapreduce.combined(((f"k{i % 9}", str(i % 2)) for i in range(40_000)), lambda k, vs: [str(sum(map(int, vs)))]))
    assert len(few) == 9 * 4 and sum(int(v) for _, v in few) == 20_000


def test_fnv_of_a_batch(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from glyphmill.functions import text as X

    words = ["", "a", None, "10", "été", "\U00010348x", "long " * 50, "#D"]
    rows = spark.createDataFrame([(x,) for x in words], "s string").select(X.fnv1a(F.col("s"))).collect()
    assert X.fnv1a_batch(pa.array(words)).to_pylist() == [r[0] for r in rows] and X.fnv1a_batch(pa.array([], pa.string())).to_pylist() == []


def test_a_failing_program_fails_the_task(spark):
    fail = mapreduce.executable(["false"])
    with pytest.raises(Exception, match="ended with 1"):
        mapreduce.map_lines(spark.createDataFrame([("x",)], "value string"), lambda ls: ((x, "1") for x in fail(ls))).collect()


def page(i, text):
    return f"<page><title>Page {i}</title><ns>0</ns><id>{i}</id><revision><id>{i}</id><text>{text}</text></revision></page>"


def test_a_job_from_dump_to_hits(spark, tmp_path):
    words = ["apple", "pear", "plum", "grape"]
    body = "".join(page(i, f"{words[i % 4]} {words[i % 3]} common") for i in range(60))
    (tmp_path / "dump.xml").write_text(f"<mediawiki>{body}</mediawiki>")
    spark.createDataFrame([(1, "apple"), (2, "nothing")], "qid long, q string").write.parquet(str(tmp_path / "q"))
    at = lambda x: str(tmp_path / x)
    spec = {"name": "all", "tasks": [
        {"spec": "reformat", "input": [at("dump.xml")], "output": at("json"), "groups": 2, "parts": 2}, {"spec": "index", "input": at("json"), "output": at("index")},
        {"spec": "search", "index": at("index"), "queries": at("q"), "output": at("hits")}, {"spec": "wordcount", "input": at("dump.xml"), "output": at("words")},
    ]}
    (tmp_path / "job.json").write_text(json.dumps(spec))
    assert jobs.run_job(spark, jobs.read_spec(at("job.json")))
    hits = spark.read.parquet(at("hits")).collect()
    assert len(hits) == sum("apple" in (words[i % 4], words[i % 3]) for i in range(60)) and {r["qid"] for r in hits} == {1}
    # documents are dealt to the groups in turn
    assert {(r["group_id"], r["doc_id"]) for r in hits} == {(i % 2, i // 2) for i in range(60) if "apple" in (words[i % 4], words[i % 3])}


@pytest.mark.parametrize("spec", [{}, {"name": "x"}, {"name": "x", "tasks": [{"spec": "other"}]}])
def test_bad_jobs(spark, spec):
    with pytest.raises(ValueError):
        jobs.run_job(spark, spec)
