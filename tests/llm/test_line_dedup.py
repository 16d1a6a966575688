"""Line dedup against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import line_dedup

WORDS = [f"w{i}" for i in range(300)]


def brute(rows, t=0.8, least=3):
    """Text that stays of each (doc_id, text), in the order of doc_id; distinct ids."""
    seen, out = [], {}
    for doc, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            s = set(re.findall(r"[^\W_]+", line.lower()))
            repeated = len(s) >= least and any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
            if len(s) >= least:
                seen.append(s)
            if not repeated:
                kept.append(line)
        out[doc] = "\n".join(kept)
    return out


def corpus(seed, docs=120):
    rng = random.Random(seed)
    lines = [" ".join(rng.choices(WORDS, k=rng.choice([1, 3, 5, 9, 20, 60, 130]))) for _ in range(80)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            text.append(" ".join(line) + rng.choice(["", ".", "  "]))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: r[1] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_many_copies_go_through_the_second_round(spark):
    """Groups above the number of candidates that the first round keeps."""
    rng = random.Random(3)
    base = rng.choices(WORDS, k=40)
    rows = []
    for i in range(90):
        line = list(base)
        for j in rng.sample(range(40), rng.choice([1, 2, 3, 4, 8])):
            line[j] = rng.choice(WORDS)
        rows.append((i, " ".join(line)))
    got = {r[0]: r[1] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_near_misses_send_no_row_for_each_pair(spark, monkeypatch):
    """What the groups of words pass on follows the lines, not the pairs of lines that all resemble each other; results stay exact."""
    rng = random.Random(8)
    base = rng.sample(WORDS, 50)
    rows = [(i, " ".join([*base[:43], *rng.sample(WORDS, 7)])) for i in range(160)]
    sent = []
    save = line_dedup.Workspace.save

    def counted(self, df, name):
        out = save(self, df, name)
        sent.append(out.count() if name != "shared" else out.select("doc", "at", "y_doc", "y_at").distinct().count())
        return out

    monkeypatch.setattr(line_dedup.Workspace, "save", counted)
    got = {r[0]: r[1] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert max(sent) <= 5 * len(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_groups_in_blocks(spark, seed):
    """Groups above the size of one task are compared block by block."""
    rows = corpus(seed, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r[0]: r[1] for r in line_dedup.drop_repeated_lines(df, together=6).collect()}
    assert got == brute(rows)


def test_short_lines_that_share_a_word_stay(spark):
    """Distinct lines whose Jaccard is at most one half, all in the group of one word."""
    rows = [(i, "\n".join(f"common q{i}x q{j}x" for j in range(i))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_dedup.removed_lines(df).count() == 0


def test_long_lines_of_few_words_go_too(spark):
    word = "字" * 40
    rows = [(1, word), (2, word + "\n---\n---"), (3, "一二")]
    got = {r[0]: r[1] for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: word, 2: "---\n---", 3: "一二"}


def test_defined_results(spark):
    long = " ".join(f"z{i}" for i in range(30000))
    rows = [
        (None, "a b c d", 1), (1, None, 2), (2, "", 3), (3, "a b c d\nx", 4), (4, "A, b. C d\ny", 5), (4, "A, b. C d\ny", 5),
        (5, "a b c d", None), (6, long, 7), (7, long + "\nnew one here", 8), (8, "one two\none two", 9),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    clash = ["count", "gm_key", "gm_lines", "__gm_gone", "doc", "at", "hash"]
    for c in clash:
        df = df.withColumn(c, F.col("x"))
    out = line_dedup.drop_repeated_lines(df, count="gone")
    assert out.columns == ["doc_id", "text", "x", *clash, "gone"]
    assert out.where("not (x <=> count and x <=> gm_key and x <=> gm_lines and x <=> __gm_gone and x <=> doc and x <=> at and x <=> hash)").count() == 0
    got = sorted(map(tuple, out.select("doc_id", "text", "x", "gone").collect()), key=str)
    replaced = line_dedup.drop_repeated_lines(df, count="count")
    assert sorted(replaced.columns) == sorted(["doc_id", "text", "x", *clash]) and replaced.agg(F.sum("count")).first()[0] == 4
    want = [
        (None, "a b c d", 1, 0), (1, None, 2, 0), (2, "", 3, 0), (3, "a b c d\nx", 4, 0), (4, "y", 5, 1), (4, "y", 5, 1),
        (5, "", None, 1), (6, long, 7, 0), (7, "new one here", 8, 1), (8, "one two\none two", 9, 0),
    ]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
