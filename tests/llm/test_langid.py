"""Language ID: held-out accuracy, rejection of what isn't one of the labels, and the stated cases."""

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import langid, textnum

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


OTHER = [
    "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli, jota puhuvat pääosin suomalaiset. Suomessa suomen kieltä puhuu äidinkielenään noin viisi miljoonaa ihmistä.",
    "int main(void) { for (int i = 0; i < n; ++i) { buf[i] = malloc(sizeof(struct node)); if (!buf[i]) return -1; printf(\"%d\\n\", i); } return 0; }",
    "def foo(x):\n    return np.array([y for y in x if y is not None]).astype(np.float32)\n" * 3,
    "これは日本語の文章です。とても短いです。", "zxqv kjwq pfft " * 20,
]


def test_held_out_accuracy(spark, model):
    assert model.held_out_accuracy > 0.98
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.language == got.lang).mean() > 0.98 and got.accepted.mean() > 0.99


def test_other_languages_and_code_are_rejected(model):
    _, prob, ok = langid.classify(model, *textnum.string_buffers(pa.array(OTHER)))
    assert not ok.any() and (prob <= 1).all()


def test_classify_is_the_softmax_of_averaged_embeddings(model):
    """One text by loops over its subwords."""
    text = "The theon anhe, onth"
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    grams = [spaced[i : i + n] for n in langid.SIZES for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1 : i + n - 1] and (n > 2 or " " not in spaced[i : i + n])]
    h, _ = langid.subwords(*textnum.string_buffers(pa.array([text])))
    assert len(h) == len(grams) and len(set(h)) == len(set(grams))
    z = model.scores[:, h].mean(axis=1) + model.bias
    p = np.exp(z) / np.exp(z).sum()
    best, prob, _ = langid.classify(model, *textnum.string_buffers(pa.array([text])))
    assert best[0] == p.argmax() and prob[0] == pytest.approx(p.max(), abs=1e-5)


def test_defined_results(spark, model):
    long = "the of and to in that " * 50000
    rows = [(1, None), (2, ""), (3, " .,!\n"), (4, long), (None, "the of and to in"), (6, "the of and to in"), (6, "the of and to in")]
    df = spark.createDataFrame([(a, b, a, a) for a, b in rows], "doc_id long, text string, language long, accepted long")
    got = {(r["doc_id"], r["language"], r["accepted"]) for r in langid.identify(df, model).collect()}
    assert got == {(1, None, False), (2, None, False), (3, None, False), (4, "en", True), (None, "en", True), (6, "en", True)}
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(map(str, ((r["doc_id"], r["language"]) for r in kept.collect()))) == sorted(map(str, [(4, 4), (None, None), (6, 6), (6, 6)]))
    assert langid.identify(df.where("false"), model).count() == 0


def test_without_labels_all_is_rejected(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["accepted"] for r in langid.identify(df, langid.fit(df)).collect()] == [False]
    assert langid.fit(df.where("false")).labels == []
