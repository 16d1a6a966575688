"""Text functions, markup and retrieval quirks."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as X
from glyphmill.functions import wikitext
from glyphmill.functions.porter2 import stem
from glyphmill.operators import search, snippet
from glyphmill.sources import pages as P


@pytest.mark.parametrize("word, want", [
    ("consignment", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("skies", "sky"),
    ("hopping", "hop"), ("hoping", "hope"), ("Apple", "appl"), ("relational", "relat"), ("cries", "cri"), ("ties", "tie"), ("news", "news"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_fnv_and_rounding(spark):
    df = spark.createDataFrame([("0",), ("10",), ("#D",)], "s string").select(X.fnv1a(F.col("s")))
    assert [r[0] for r in df.collect()] == [890022063, 468396612, 1003014754]
    assert [r[0] for r in spark.createDataFrame([(1.005,), (2.675,)], "x double").select(X.round2(F.col("x"))).collect()] == [1.0, 2.68]


def test_fold_starts_anew(spark):
    def run(*lists):
        rows = [[(i, x) for i, x in enumerate(lists)]]
        return spark.createDataFrame([tuple(rows)], "l array<struct<pos: int, ids: array<bigint>>>").select(search.fold(F.col("l"))).first()[0]

    assert run([1, 2], [3]) == []
    assert run([1, 2], [3], [4, 5]) == [4, 5]


def test_snippets():
    long = " ".join(f"w{i}" for i in range(200))
    assert snippet.expand([long], 0, {"w3"}).startswith("...  w0 w1")
    assert snippet.expand([long], 0, {"w190"}).endswith("w199 ...")
    assert snippet.expand([long], 0, {"w100"}).startswith("...  w60 ")
    assert snippet.highlight("a < Running dog", {"run"}) == "a &lt; <strong>Running</strong> dog"


def test_snippet_prefix_stands_in_one_long_sentence_only():
    sents = [" ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))]
    assert snippet.expand(sents, 0, set()) == " ".join([*(f"a{i}" for i in range(50)), *(f"b{i}" for i in range(30))]) + " ..."
    assert snippet.expand(["one two"], 0, set()) == "one two ..."
    assert snippet.expand([" ".join(f"w{i}" for i in range(81))], 0, set()).startswith("...  w0 ")


def test_markup():
    assert wikitext.clean("'''A''' [[b|c]]s {{x|{{y}}}}[http://e.org site]<ref>r</ref> [[File:z.png]]\n==H==\n{|\n|t\n|}").strip() == "A cs site"
    assert wikitext.expand("{{#if:x|a|b}}{{#ifeq:1|1|y|n}}{{#expr:1+2*3}}{{#switch:b|a=1|b=2}}{{uc:q}}") == "ay72Q"
    assert "error" in wikitext.calculate("__import__('os')") and wikitext.expand("{{#iferror:{{#expr:1/0}}|bad|ok}}{{#iferror:x|bad|ok}}") == "badok"
    assert wikitext.roman(1994) == "MCMXCIV"
    assert wikitext.clean("a <nowiki>{{x}} ''b''</nowiki> {{y}}") == "a {{x}} ''b'' "


def test_index_and_offline_modes():
    page = "'''A''' ''it'' [[b|c]]s<ref name=a/> <ref>r</ref>\n\n==H==\ntext &amp; more\n====D===="
    assert wikitext.clean(page, mode="index") == 'A "it" cs \ntext & more\nD'
    assert wikitext.clean(page, mode="offline") == 'A "it" cs \n\n==H==\ntext & more\n====D===='
    with pytest.raises(ValueError):
        wikitext.clean(page, mode="other")


def test_lists_sections_and_placeholders():
    page = "intro\n==Empty==\n==Full==\nline <math>x</math> and <code>y</code> <math>x</math> <math>z</math>\n* item\n# one\n# two\n: indent\nafter .....,. end"
    assert wikitext.clean(page, lists=True) == "intro\nFull.\nline formula_1 and codice_1 formula_1 formula_3\n- item\n1. one\n2. two\nafter .... end"
    assert wikitext.clean("==H==\nx\n* a", sections=False) == "x"


@pytest.mark.parametrize("call, want", [
    ("String|len|abc", "3"), ("String|sub|abcdef|2|3", "bc"), ("String|sub|abcdef|-2", "ef"), ("String|sublength|abcdef|1|2", "ab"), ("String|sublength|s=abcdef|i=2|len=3", "bcd"),
    ("String|pos|abc|2", "b"), ("String|find|abcabc|c", "3"), ("String|find|source=abcabc|target=c|start=4", "6"), ("String|replace|aaa|a|b|2", "bba"), ("String|rep|ab|3", ""),
    ("Roman|main|12", "XII"), ("Roman|main|9999|big", "big"), ("If empty|main||x|y", "x"), ("convert|convert|5|km", "5 km"), ("Other|main|1", ""), ("String|pos|abc|x", ""),
])
def test_modules(call, want):
    assert wikitext.expand("{{#invoke:" + call + "}}") == want


def test_templates():
    table = wikitext.template_table([
        ("Template:A", "x<onlyinclude>only {{{1|d}}} {{{n}}}</onlyinclude>y"), ("Template:B", "#REDIRECT [[Template:A]]"), ("Template:C", "<noinclude>no</noinclude>c{{{{{p|q}}}|z}}"),
        ("Template:Loop", "{{loop}}"), ("Template:R", "#redirect [[Template:R]]"), ("Page", "main {{PAGENAME}}"),
    ])
    assert wikitext.parameters(table["Template:C"], {"p": "name"}) == "c{{name|z}}" and wikitext.parameters(table["Template:C"], {}) == "c{{q|z}}"
    assert wikitext.expand("{{b|k=1|first|n=second}}|{{unknown|x}}|{{loop}}|{{r}}", table) == "only first second|||"
    assert wikitext.template_title(":main page") == "Main page" and wikitext.template_title("template: x_y") == "Template:X y" and wikitext.template_title("foo:bar") == "Template:Foo:bar"
    words = wikitext.magic_words("Help:A/b/c")
    assert (words["NAMESPACE"], words["PAGENAME"], words["BASEPAGENAME"], words["SUBPAGENAME"], words["ROOTPAGENAME"]) == ("Help", "A/b/c", "A/b", "c", "A")
    assert wikitext.expand("{{PAGENAME}}{{!}}", words=words) == "A/b/c|"


def test_token_spans(spark):
    row = spark.createDataFrame([("Running a run, ran: run",)], "s string").select(X.token_spans(F.col("s"), stems=True).alias("t")).select("t", X.token_positions(F.col("t")).alias("p")).first()
    assert [tuple(t) for t in row["t"]] == [("run", 0, 7), ("run", 10, 13), ("ran", 15, 18), ("run", 20, 23)]
    assert [tuple(x) for x in row["p"]["run"]] == [(0, 7), (10, 13), (20, 23)]


DUMP = """<mediawiki><siteinfo><base>https://x.org/wiki/Main_Page</base><namespaces><namespace key="0"/><namespace key="10">Template</namespace></namespaces></siteinfo>
<page><title>One</title><ns>0</ns><id>1</id><revision><id>10</id><text>'''One''' {{t}} text</text></revision></page>
<page><title>One</title><ns>0</ns><id>1</id><revision><id>11</id><text>newer</text></revision></page>
<page><title>Two</title><ns>0</ns><id>2</id><redirect title="One"/><revision><id>20</id><text>#REDIRECT [[One]]</text></revision></page>
<page><title>Three</title><ns>0</ns><id>3</id><revision><id>30</id><text>{{disambig}} three</text></revision></page>
<page><title>Empty</title><ns>0</ns><id>5</id><revision><id>50</id></revision></page>
<page><title>Wikipedia:P</title><ns>0</ns><id>6</id><revision><id>60</id><text>project</text></revision></page>
<page><title>Last</title><ns>0</ns><id>7</id><revision><id>70</id><text>last one</text></revision></page>
<page><title>Template:T</title><ns>10</ns><id>4</id><revision><id>40</id><text>from template</text></revision></page></mediawiki>"""


def test_a_dump_from_xml_to_json_lines(spark, tmp_path):
    import bz2

    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    path = str(tmp_path / "dump.xml.bz2")
    pages = P.wiki_pages(spark, path)
    assert sorted((r["id"], r["revid"]) for r in P.articles(pages).collect()) == [(1, 10), (3, 30), (5, 50), (6, 60), (7, 70)]
    assert {r["id"] for r in P.articles(pages, disambiguation=False).collect()} == {1, 5, 6, 7}
    assert P.site_base(spark, path).first().asDict() == {"base": "https://x.org/wiki/Main_Page", "url_prefix": "https://x.org/wiki/"}
    assert {(r["key"], r["name"]) for r in P.site_namespaces(spark, path).collect()} >= {("10", "Template")}
    table = wikitext.collect_templates(P.templates(pages))
    out = P.ingest(P.articles(pages), groups=2, templates=table, url_prefix="https://x.org/wiki/")
    assert sorted(map(tuple, out.collect())) == [
        (0, 0, "One", "https://x.org/wiki/One", "One from template text"), (0, 1, "Last", "https://x.org/wiki/Last", "last one"), (1, 0, "Three", "https://x.org/wiki/Three", " three"),
    ]
    P.write_json_lines(out, str(tmp_path / "out"), 2)
    assert P.from_json_lines(spark.read.text(str(tmp_path / "out"), recursiveFileLookup=True)).count() == 3
    P.write_extracted(out, str(tmp_path / "x"), as_json=True, bytes_per_file=10)
    assert len(list((tmp_path / "x").glob("*.txt"))) >= 2
    P.write_records(spark.createDataFrame([("b", "1"), ("a", "2"), ("b", "3")], "key string, value string"), str(tmp_path / "r"), 2)
    assert sorted(map(tuple, P.read_records(spark, str(tmp_path / "r")).collect())) == [("a", "2"), ("b", "1"), ("b", "3")]
    assert [r[0] for r in spark.range(1).select(P.page_url_by_id(F.lit(7), "https://x.org/w/i%20")).collect()] == ["https://x.org/w/i%20?curid=7"]


def test_cleaning_holds_few_texts_at_once(spark):
    """A large batch costs the worker little beside the batch itself and its result."""
    import tracemalloc

    import pyarrow as pa

    pages = pa.array([f"{i} [[a|b]] " + "\u4e00 word " * 2000 for i in range(1000)])
    tracemalloc.start()
    out = wikitext.in_pieces(lambda t: t and wikitext.clean(t, mode="index"), pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1000 and out[7].as_py() == wikitext.clean(pages[7].as_py(), mode="index") and wikitext.in_pieces(str, pages[:0]).to_pylist() == []
    assert peak < 16 << 20  # all texts as strings take 32 MB, and as much again for the results
    rows = spark.createDataFrame([("[[b]]",), (None,)], "t string").select(wikitext.clean_column("t", mode="index")).collect()
    assert [r[0] for r in rows] == ["b", None]
