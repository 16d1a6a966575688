"""Token counts of sections and fields against counting by loops."""

import pytest

from glyphmill.llm import bpe, token_counts

CODEC = bpe.Codec(bpe.read_vocabulary(bpe.VOCABULARY))
TEXTS = ["", "one line", "a b\n\n\nc d e\n", "\n", "\n\n  \n x\n", "Grüße\n世界 and \U0001f600\n\U0001f600", "x\n" * 300, "word " * 50_000 + "\nend"]


def brute(text, starts, rule):
    """Tokens of each span; starts are byte offsets."""
    raw = text.encode()
    owner = [max(i for i, s in enumerate(starts) if s <= b) for b in range(len(raw))] if len(raw) < 5000 else None
    out, at = [0] * len(starts), 0
    for t in CODEC.encode(text):
        end = at + len(CODEC.strings[t])
        if owner is None:
            spans = [max(i for i, s in enumerate(starts) if s <= b) for b in range(at, end)]
        else:
            spans = owner[at:end]
        out[{"start": spans[0], "end": spans[-1], "overlap": max(sorted(set(spans)), key=lambda s: spans.count(s))}[rule]] += 1
        at = end
    assert at == len(raw)
    return out


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    rows = list(enumerate(TEXTS)) + [(100, None), (None, "null id\nhere"), (0, "again\n")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, section int")
    got = {}
    for r in token_counts.count_by_section(df, rule=rule).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["char_start"], r["char_end"], r["n_tokens"]))
    assert 100 not in got
    for doc, text in rows[: len(TEXTS)] + [(None, "null id\nhere")]:
        if doc == 0:
            continue  # two documents
        lines = text.split("\n")
        lines = [line + "\n" for line in lines[:-1]] + [lines[-1]] * bool(lines[-1] or len(lines) == 1)
        starts = [len("".join(lines[:i]).encode()) for i in range(len(lines))]
        ends = [len("".join(lines[: i + 1])) for i in range(len(lines))]
        assert sorted(got[doc]) == [(i, e - len(line), e, n) for i, (line, e, n) in enumerate(zip(lines, ends, brute(text, starts, rule)))]
    assert sorted(got[0]) == [(0, 0, 0, 0), (0, 0, 6, len(CODEC.encode("again\n")))], rule
    assert token_counts.count_by_section(df.where("false")).count() == 0


def test_fields(spark):
    rows = [(1, "a title", "some body\ntext"), (2, None, "x"), (None, "", ""), (2, None, "x")]
    df = spark.createDataFrame(rows, "field long, title string, body string")
    for key, name in (("field", "key"), ("id", "id")):
        out = token_counts.count_by_field(df.withColumnRenamed("field", key), key, ["title", "body"])
        assert out.columns == [name, "field", "n_tokens"]
        want = []
        for k, a, b in rows:
            a, b = (a or "") + "\n", b or ""
            want += zip([k] * 2, ["title", "body"], brute(a + b, [0, len(a)], "overlap") if b else [len(CODEC.encode(a)), 0])
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
