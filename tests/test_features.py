"""Terms counted in their document's row, TF-IDF beside the vocabulary, against plain Python; nothing is shuffled by document."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievewright.operators import features as X
from sievewright.operators import language as L
from sievewright.operators import remap as P

ROWS = [(1, "aa bb aa cc"), (2, None), (3, ""), (4, "bb bb"), (1, "aa dd"), (5, "cc aa bb aa"), (None, "dd aa"), (None, "dd")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_key():
    out = {}
    for i, text in ROWS:
        out.setdefault(i, Counter()).update((text or "").split())
    return out


def words():
    return F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")


def test_counted(spark):
    df = spark.createDataFrame([(["b", "a", "b", "", "a", "b"],), ([],), (["z"],)], "t array<string>")
    got = [{(x.term, x.n) for x in r.c} for r in df.select(X.counted(F.col("t")).alias("c")).collect()]
    assert got == [{("", 1), ("a", 2), ("b", 3)}, set(), {("z", 1)}]


def test_counts_of_rows_that_share_a_key(docs):
    got = {(r.doc_id, r.term): r.n for r in X.term_counts(docs, "doc_id", words()).collect()}
    assert got == {(i, t): n for i, c in by_key().items() for t, n in c.items()}


def test_tfidf(docs):
    lists = X.term_lists(docs, "doc_id", words())
    vocab = X.vocabulary(X.list_counts(lists, "doc_id"), 2, 3)
    assert {r.term: (r.df, r.total) for r in vocab.collect()} == {"aa": (3, 6), "bb": (3, 4), "dd": (2, 3)}
    idf = {r.term: math.log((1 + 6) / (1 + r.df)) + 1 for r in vocab.collect()}
    got = {(r.doc_id, r.term): r.weight for r in X.tfidf(lists, vocab, 6, "doc_id").collect()}
    want = {}
    for i, c in by_key().items():
        w = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / norm for t, x in w.items()}
    assert got == pytest.approx(want)


def test_no_term_is_shuffled_by_document(spark):
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    assert "Exchange" not in plan(X.char_term_counts(docs, "doc_id", F.col("text"), 3, 5))
    terms = X.stacked_terms(docs, "doc_id", "text")
    assert "Exchange" not in plan(X.stacked_lists(terms, X.stacked_vocabulary(terms, "doc_id"), 20, "doc_id"))
    assert "Exchange" not in plan(L.window_grams(docs, "doc_id", F.split("text", " ")))
    ranks = plan(P.context_ranks(docs, "doc_id", F.split("text", " ")))
    assert not re.search(r"hashpartitioning\(doc_id#\w+, \w+#", ranks)


def test_stacked_weights_stay_in_their_row(spark):
    texts = ["one two three two", "two three four", None, "", "Ünder one two", "zz", "one three two one two three"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id long, text string, more string")
    terms = X.stacked_terms(df, "id", "text")
    vocab = X.stacked_vocabulary(terms, "id")
    got = X.stacked_rows(df, "text", vocab, 7)
    assert "hashpartitioning" not in plan(got) and got.columns == ["id", "text", "more", "places", "weights"]
    rows = {r.id: r for r in got.collect()}
    assert [rows[i].text for i in range(7)] == texts and {r.more for r in rows.values()} == {"kept"}
    want = {}
    for r in X.stacked_tfidf(terms, vocab, 7, "id").collect():
        want.setdefault(r.id, []).append((r.place, r.weight))
    assert {len(want.get(i, [])) for i in (2, 3)} == {0} and max(map(len, want.values())) > 20
    for i, r in rows.items():
        own = sorted(want.get(i, []))
        assert r.places == [p for p, _ in own] and r.weights == pytest.approx([w for _, w in own])


def test_bigram_scores(docs):
    pairs = [(i, a, b) for i, text in ROWS for w in [(text or "").split()] for a, b in zip(w, w[1:], strict=False)]
    both, first, types = Counter((a, b) for _, a, b in pairs), Counter(a for _, a, _ in pairs), len({b for _, _, b in pairs})
    want = {}
    for i, a, b in pairs:
        want.setdefault(i, []).append(math.log((both[a, b] + 1) / (first[a] + types)))
    got = {r.doc_id: (r.tokens, r.ll) for r in X.bigram_scores(docs, "doc_id", words()).collect()}
    assert set(got) == set(want)
    for i, x in want.items():
        assert got[i] == (len(x), pytest.approx(sum(x) / len(x)))


def test_entropies_find_tokens_once(docs):
    lists = X.term_lists(docs, "doc_id", words())
    got = {r.doc_id: r.entropy for r in X.entropies(lists, "doc_id").collect()}
    want = {i: -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values()) for i, c in by_key().items() if c}
    assert got == pytest.approx(want)
    text = docs.filter("doc_id = 5")
    once = X.entropies(X.term_lists(text, "doc_id", X.word_tokens(X.fold(F.col("text")))), "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert once.count(X.TOKEN) == 1


def test_tokens_of_plain_and_other_texts(spark):
    texts = ["Ab a_b, x yz 12!", "", None, "\u00c9t\u00e9 a b cd", "na\u00efve \u0645\u0631\u062d\u0628\u0627 a\u0301b x\u0301", "\u4f60\u597d \u4f60 \U0001d400\U0001d401 z", "_ __ a-b-cd", "\u00bd \u01c6x \u017f"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    old = F.translate(F.lower(F.coalesce("text", F.lit(""))), *X.ACCENTS)
    for r in df.select(X.fold(F.col("text")).alias("a"), old.alias("b"), X.word_tokens(X.fold(F.col("text"))).alias("c"), F.regexp_extract_all(old, F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1)).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)


@pytest.mark.parametrize("frequent", [0, 2, 100])
def test_part_sums(docs, monkeypatch, frequent):
    monkeypatch.setattr(X, "FREQUENT", frequent)
    model = X.unigram_model(docs.filter("doc_id is not null"), words())
    logp = {r.token: r.logp for r in model.collect()}
    want = {}
    for i, text in ROWS:
        for at, t in enumerate((text or "").split(), 1):
            if i is not None and t in logp:
                want.setdefault((i, at % 3), []).append(logp[t])
    sums = X.part_sums(docs.filter("doc_id is not null"), "doc_id", words(), model, 3)
    assert {(r.doc_id, r.k): (r.lp, r.n) for r in sums.collect()} == {k: (pytest.approx(sum(v)), len(v)) for k, v in want.items()}


def test_long_batches_are_weighed_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(i, "one two three two" if i % 5 else None) for i in range(40)], "id long, text string").coalesce(1)
    terms = X.stacked_terms(df, "id", "text")
    vocab = X.stacked_vocabulary(terms, "id")
    whole = {r.id: r for r in X.stacked_rows(df, "text", vocab, 40).collect()}
    monkeypatch.setattr(X, "PIECE", 50)
    assert {r.id: r for r in X.stacked_rows(df, "text", vocab, 40).collect()} == whole and len(whole) == 40
    batch = pa.RecordBatch.from_pylist([{"a": [1] * n, "b": [2]} for n in (0, 3, 9, 1, 1, 0)])
    cut = list(X.pieces(batch, ["a", "b"], 6))
    assert [p.num_rows for p in cut] == [2, 1, 3] and pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()


def test_terms_are_cut_in_tasks(spark, monkeypatch):
    texts = ["one two a one two", "aaaaaa b", None, "", "  ", "Ünder one\ttwo", "\U0001d400\U0001d401z x", "two one"] * 3
    df = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts)], "id long, text string").repartition(2)
    old = {
        "char": X.term_counts(df, "id", X.char_ngrams(X.fold(F.col("text")), 3, 5)),
        "word": X.term_counts(df, "id", X.ngrams(X.word_tokens(X.fold(F.col("text"))), 1, 2)),
    }
    want = {name: {(r.term, r.df, r.total) for r in c.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total")).collect()} for name, c in old.items()}
    for words, remembered in ((100_000, 1_000_000), (3, 4)):
        monkeypatch.setattr(X, "WORDS", words)
        monkeypatch.setattr(X, "REMEMBERED", remembered)
        lists = X.stacked_terms(df, "id", "text")
        for name, (_, make, *_) in X.BLOCKS.items():
            got = X.term_totals(lists[name], make)
            assert {(r.term, r.df, r.total) for r in got.collect()} == want[name]
            assert "Generate" not in plan(got)  # no row for each term of each document
    assert len(want["char"]) == 42 and len(want["word"]) == 8
