"""The index, the search with stems and the snippets against loops over a small corpus."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.porter2 import stem
from glyphmill.functions.text import STOP_WORDS
from glyphmill.operators import index as I
from glyphmill.operators import search, snippet

S = I.Settings()
WORDS = "run running runner apple apples Apple relation relational search searching engine engines the and of hopping hope index query queries rank ranked token tokens stem data".split()


def analyse(text):
    return [t for w in re.findall(r"\w\w+", text) for t in dict.fromkeys((w, stem(w)))]


def fnv(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 % (1 << 32)
    return h


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS[rng.randrange(20) :], k=rng.randint(1, 60))
        text = "".join(w + rng.choice([" ", " ", " ", ". ", ", "]) for w in words)
        rows.append((i, " ".join(rng.choices(WORDS, k=rng.randint(1, 3))) if i % 3 else "", text))
    return rows


class Brute:
    def __init__(self, rows, s=S):
        self.s, self.rows = s, {d: (t, b) for d, t, b in rows}
        self.place = {d: (d % s.groups, fnv(str(d)) % s.shards) for d in self.rows}
        tf = {d: Counter(t for t in analyse(b.lower()) if t not in STOP_WORDS) for d, (_, b) in self.rows.items()}
        lists = defaultdict(list)
        df = defaultdict(Counter)
        for d, c in tf.items():
            for t, n in c.items():
                lists[*self.place[d], t].append((-n, str(d), d))
                df[self.place[d][0]][t] += 1
        self.postings = {k: [d for _, _, d in sorted(v)[: s.postings_cap]] for k, v in lists.items()}
        size = Counter(g for g, _ in self.place.values())
        total = Counter()
        for g, c in df.items():
            total.update({t: n for t, n in c.items() if max(s.group_df_above, s.group_df_share * size[g]) < n < size[g]})
        self.idf = {t: math.log((len(rows) + 1) / (n + 1)) + 1 for t, n in total.items() if s.global_df_above < n < len(rows)}
        self.weight = {}
        for d, (title, _) in self.rows.items():
            w = Counter(tf[d])
            if title:
                for t in analyse(title.lower()):
                    w[t] += s.title_bonus * (10 / len(title.split(" "))) ** 2
            self.weight[d] = {t: x * self.idf[t] for t, x in w.items() if t in self.idf}

    def fold(self, where, terms):
        out = []
        for t in terms:
            if (*where, t) in self.postings:
                ids = self.postings[*where, t]
                out = [d for d in out if d in ids] if out else ids
        return out

    def search(self, q):
        asked = Counter(analyse(q.lower()))
        found = []
        for where in {*self.place.values()}:
            exact = self.fold(where, re.findall(r"\w\w+", q))
            loose = [d for d in self.fold(where, analyse(q)) if d not in exact]
            for phase, ids in enumerate((exact, loose)):
                for d in ids:
                    dot = sum(n * self.idf[t] * self.weight[d].get(t, 0) for t, n in asked.items() if t in self.idf)
                    found.append((-(round(dot * (1.0, self.s.blur_weight)[phase] * 100) / 100), *where, phase, d))
        return [(g, h, d, p, -x) for x, g, h, p, d in sorted(found)[: self.s.hits]]


QUERIES = [(1, "running engine"), (2, "Apple"), (3, "zzz relational"), (4, "queries rank the data"), (5, "zzz"), (6, ""), (7, "searching hope hopping"), (8, "tokens")]


@pytest.fixture(scope="module")
def built(spark):
    rows = corpus()
    docs = I.corpus(spark.createDataFrame(rows, "doc_id long, title string, text string"), S, title=F.col("title"))
    return rows, I.build(docs, S), spark.createDataFrame(QUERIES, "qid long, q string")


def test_search_equals_loops(built):
    rows, index, asked = built
    brute = Brute(rows)
    got = defaultdict(list)
    for r in search.search(index, asked).orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["group_id"], r["shard"], r["doc_id"], r["phase"], r["score"]))
    for qid, q in QUERIES:
        want = brute.search(q)
        assert [x[:4] for x in got[qid]] == [x[:4] for x in want], q
        assert [x[4] for x in got[qid]] == pytest.approx([x[4] for x in want])
    assert any(p for hits in got.values() for *_, p, _ in hits) and not got[5] and not got[6]


def test_a_written_index_gives_the_same_hits(spark, built, tmp_path):
    _, index, asked = built
    index.write(str(tmp_path))
    again = I.open_index(spark, str(tmp_path))
    key = ["qid", "rank", "group_id", "shard", "doc_id", "phase", "score"]
    one, two = (sorted(map(tuple, search.search(i, asked).select(*key).collect())) for i in (index, again))
    assert one == two
    plan = again.postings.where("group_id = 1 and shard = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(group_id" in plan


def test_result_pages_equal_single_snippets(built):
    rows, index, asked = built
    brute = Brute(rows)
    hits = search.page_of(search.search(index, asked), 1)
    texts = {d: (t, b) for d, t, b in rows}
    found = snippet.result_page(index, asked, hits).collect()
    assert len(found) == hits.count() > 10
    for r in found:
        title, body = texts[r["doc_id"]]
        assert r["title"] == title and r["snippet"] == snippet.document_snippet(body, dict(QUERIES)[r["qid"]], brute.idf)


def test_documents_are_read_twice_at_most(spark, tmp_path):
    rows = corpus(n=30)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(path)
    index = I.build(I.corpus(spark.read.parquet(path), S, title=F.col("title")), S)
    plan = search.search(index, spark.createDataFrame(QUERIES, "qid long, q string"))._jdf.queryExecution().executedPlan().toString()
    assert path not in plan


def test_postings_are_capped_with_ties_by_text(spark):
    docs = I.corpus(spark.createDataFrame([(4 * i, "apple " * (2 if i == 100 else 1)) for i in range(120)], "doc_id long, text string"), I.Settings(shards=1))
    ids = [p["doc_id"] for p in I.postings(I.term_freq(docs, S), S).where("term = 'apple'").first()["postings"]]
    assert len(ids) == 100 and ids == [400] + sorted((4 * i for i in range(120) if i != 100), key=str)[:99]


def test_groups_are_dealt_in_turn(spark):
    rows = [(i,) for i in random.Random(2).sample(range(10_000), 500)]
    got = I.assign_groups(spark.createDataFrame(rows, "page_id long").repartition(9), "page_id", 3).collect()
    order = sorted(r[0] for r in rows)
    assert {r["page_id"]: (r["group_id"], r["local_id"]) for r in got} == {p: (i % 3, i // 3) for i, p in enumerate(order)}
    assert I.assign_groups(spark.createDataFrame([], "page_id long"), "page_id", 3).count() == 0


@pytest.mark.parametrize("wrong", [{"groups": 0}, {"shards": -1}, {"hits": 0}, {"blur_weight": 2.0}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        I.Settings(**wrong)


def test_scores_of_sentences_add_up_in_the_order_of_tokens(spark):
    """Sentences of the same tokens in another order differ in the last bit at most, and that bit decides."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(12)]
    idf = {w: 1 + rng.random() * 5 for w in words}
    rows = [(1, 0, d, ["nothing"] + [" ".join(rng.sample(words, 9 if d % 2 else 12)) for _ in range(8)]) for d in range(200)]
    index = I.Index(None, None, spark.createDataFrame([(w, 0, 20, x) for w, x in idf.items()], "term string, term_id long, df long, idf double"), None, I.Settings(stems=False))
    asked = spark.createDataFrame([(1, " ".join(words))], "qid long, q string")
    docs = spark.createDataFrame(rows, "qid long, group_id int, doc_id long, sents array<string>")

    def score(sent):
        total = 0.0
        for t in sent.split():
            total += idf.get(t, 0.0) * idf.get(t, 0.0) * S.verbatim_term
        return total

    got = {r["doc_id"]: r["sent_id"] for r in snippet.best_sentences(index, asked, docs).collect()}
    assert got == {d: max(range(9), key=lambda i: (score(sents[i]), -i)) for _, _, d, sents in rows}


def test_idf_has_the_last_bit_of_the_c_library(spark):
    got = spark.range(11, 3000).select("id", I.idf(F.lit(20_000), "id").alias("idf")).collect()
    assert all(r["idf"] == math.log(20_001 / (r["id"] + 1)) + 1 for r in got)


def test_inverted_rows_hold_the_frequencies(spark):
    """Also where a document comes in several rows, or has no terms; the frequencies aren't shuffled."""
    rows = [(d, t) for d, _, t in corpus(n=60)] + [(3, "apples running apple"), (3, "the and"), (61, ""), (62, "the of and"), (-5, "apple"), (64, None)]
    docs = I.corpus(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), S)
    for s in (S, I.Settings(stems=False, postings_cap=7)):
        tf, blocks = I.term_freq(docs, s), I.inverted(docs, s)
        flat = blocks.select("group_id", "shard", "term", F.explode(F.arrays_zip("ids", "tfs")).alias("e")).select("group_id", "shard", "e.ids", "term", "e.tfs")
        assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, tf.collect()))
        assert sorted(map(tuple, I.inverted_df(blocks).collect())) == sorted(map(tuple, I.shard_df(tf).collect()))
        assert sorted(map(tuple, I.merged_postings(blocks, s).collect())) == sorted(map(tuple, I.postings(tf, s).collect()))
    once = I.inverted(docs.where("doc_id <> 3"), S)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in once and "Join" not in once
