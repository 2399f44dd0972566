"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from sievewright.functions import numbers as N
from sievewright.functions import text as T
from sievewright.operators import features as X
from sievewright.operators import metrics as M
from sievewright.operators import quality as Q
from sievewright.operators import reshape as R
from sievewright.operators import rewrite as W
from sievewright.operators import sampling as S

TIED = [(0.9, 1), (0.8, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.6, 1), (0.6, 0), (0.5, 0), (0.4, 0), (0.3, 1)]


def one(spark, value, f):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(f(F.col("x"))).first()[0]


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame([("g", s, y) for s, y in TIED], "g string, score double, y int")


def test_roc(tied):
    points = M.roc_points(tied, ["g"]).orderBy("fpr", "tpr").collect()
    assert [(round(p.fpr, 9), round(p.tpr, 9), p.threshold) for p in points] == [(0, 0, math.inf), (0, 0.2, 0.9), (0.6, 0.8, 0.6), (1, 0.8, 0.4), (1, 1, 0.3)]
    assert M.roc_auc(tied, ["g"]).first().roc_auc == pytest.approx(0.62)
    assert M.pr_auc(tied, ["g"]).first().pr_auc == pytest.approx(0.7049206349)
    assert M.fpr_at_tpr(M.roc_points(tied, ["g"]), ["g"]).first().fpr == pytest.approx(0.6)


@pytest.mark.parametrize(("target", "want"), [(0.0, (0.9, 1, 0, 4, 5)), (0.5, (0.9, 1, 0, 4, 5)), (0.6, (0.6, 4, 3, 1, 2))])
def test_rules_a_and_b(tied, target, want):
    points = M.roc_points(tied, ["g"])
    for rule in (M.operating_point_a, M.operating_point_b):
        r = rule(points, ["g"], target).first()
        assert (r.threshold, r.tp, r.fp, r.fn, r.tn) == want


def test_rules_differ_on_ties(spark):
    df = spark.createDataFrame([("g", s, y) for s, y in TIED[:-1]], "g string, score double, y int")
    points = M.roc_points(df, ["g"])
    a, b = M.operating_point_a(points, ["g"], 1.0).first(), M.operating_point_b(points, ["g"], 1.0).first()
    assert (a.threshold, a.fpr, a.tp, a.fp) == (0.4, 1.0, 4, 5) and (b.threshold, b.fpr, b.tp, b.fp) == (0.6, 0.6, 4, 3)


@pytest.mark.parametrize(("target", "cut", "f1"), [(0.2, 0.2, 0.5), (0.6, 0.4, 2 / 3)])
def test_rule_c(tied, target, cut, f1):
    r = M.operating_point_c(tied.withColumn("raw", F.round(1 - F.col("score"), 9)), ["g"], target).first()
    assert r.threshold == pytest.approx(cut + 1e-12, abs=1e-13) and r.f1 == pytest.approx(f1)


def test_best_threshold_and_one_class(spark, tied):
    r = M.best_f1_threshold(tied, ["g"]).first()
    assert (r.threshold, r.best_f1) == (0.6, pytest.approx(2 / 3))
    single = spark.createDataFrame([("g", 0.1, 1), ("g", 0.7, 1), ("g", float("nan"), 0)], "g string, score double, y int")
    assert math.isnan(M.roc_auc(single, ["g"]).first().roc_auc)
    assert M.roc_points(single, ["g"]).count() == 0 and M.best_f1_threshold(single, ["g"]).first().threshold == 0.5


def test_median_threshold_of_groups_with_null_keys(spark):
    df = spark.createDataFrame([(None, 0.6, 1, None), (None, 0.4, 0, float("nan")), ("a", 0.6, 1, 0.7), ("a", 0.8, 1, 0.7)], "g string, score double, y int, decision_threshold double")
    found = {r.g: (r.threshold, r.tp, r.fn) for r in M.evaluate(df, ["g"]).collect()}
    assert found == {None: (0.5, 1, 0), "a": (0.7, 1, 1)}


@pytest.mark.parametrize(
    ("cell", "rewrite", "strict", "perturb", "listed"),
    [
        ('["a", null, " b ", ""]', ["a", None, " b "], ["a", "b"], ["a", " b ", ""], ["a", "b"]),
        ("['x','y']", ["x", "y"], ["x", "y"], ["x", "y"], []),
        ("plain", ["plain"], ["plain"], ["plain"], []),
        ("null", [None], [], [], []),
        ("nan", ["nan"], [], [], []),
        ("", [], [], [], []),
    ],
)
def test_list_cells(spark, cell, rewrite, strict, perturb, listed):
    for variant, want in (("rewrite", rewrite), ("strict", strict), ("perturb", perturb), ("json", listed)):
        assert one(spark, cell, lambda c, v=variant: T.decode_list(c, v)) == want


def test_text(spark):
    assert one(spark, "Hi  there. Are you ok?\nYes! 3.5 m", lambda c: T.sentences(c)) == ["Hi there.", "Are you ok?", "Yes!", "3.5 m"]
    assert one(spark, "\x1c a  b\x85 ", T.normalize_space) == "a b"
    ids = spark.range(1).select(T.stable_id(*[F.lit(x) for x in ("hc3", "finance", "What is x?", "X is y.", "ai", 0, 0)]), T.stable_id(*[F.lit(x) for x in ("abc", "m", 2, 42, "new text")])).first()
    assert tuple(ids) == ("9d1a424aa83dc0ac3376", "38f393a2232fe4fc25b4")
    assert [one(spark, x, T.estimate_tokens) for x in ("abcd", "abcde", " ", None)] == [1, 2, 0, 0]
    assert one(spark, "  What's Up -- Doc? ", T.slug) == "what_s_up_doc"


@pytest.mark.parametrize(("before", "after"), [("hello — world", "hello, world"), ("10–20 km", "10, 20 km"), ("a—b", "a, b"), ("— lead", "lead"), ("x — , y", "x, y")])
def test_dashes(spark, before, after):
    assert one(spark, before, T.drop_dashes) == after


def test_markdown(spark):
    assert one(spark, "Intro\n- a\n- b\n1. c\nend\n* z", T.markdown_to_prose) == "Intro a. b. c. end z."
    assert one(spark, "## Title\n---\n**b** and __c__", T.markdown_to_prose) == "Title. b and c"
    assert one(spark, "ok \U0001f600\U0001f680 done", T.drop_emoji) == "ok done"


def test_masks(spark):
    fills = "<pad> <extra_id_0> foo <extra_id_1> bar baz <extra_id_2></s>"
    assert one(spark, fills, T.extract_fills) == ["foo", "bar baz"]
    given = F.array(F.lit("foo"), F.lit("bar baz"))
    assert one(spark, "a <extra_id_0> b <extra_id_1> c", lambda c: T.apply_fills(c, given)) == "a foo b bar baz c"
    assert one(spark, "<extra_id_0> <extra_id_1> <extra_id_2>", lambda c: T.apply_fills(c, given)) == ""


@pytest.mark.parametrize(("answer", "score"), [('{"score": 4}', 4), ('Answer: {"label":"Strongly Agree"}', 5), ("I would say 2.", 2), ("Neutral", None), ('{"label":"neutral"}', 3), ("great", None), ("I strongly disagree", 1), ("Strongly Agree", 4)])
def test_likert(spark, answer, score):
    assert one(spark, answer, T.likert_score) == score


def test_labels(spark):
    assert [one(spark, x, T.coerce_label) for x in (" Human ", "LLM", "0")] == ["human", "ai", "human"]
    with pytest.raises(Exception, match="unknown label"):
        one(spark, "robot", T.coerce_label)


def test_numbers(spark):
    r = spark.range(1).select(
        N.burstiness(F.array(F.lit(2.0), F.lit(4.0), F.lit(6.0))), N.burstiness(F.array(F.lit(3.0))), N.cost(F.lit(8), F.lit(4), F.lit(0.75), F.lit(4.5)),
        N.curvature(F.lit(-2.0), F.lit(-3.0)), N.curvature(F.lit(-2.0), F.lit(-3.0), F.lit(0.408248290463863)), N.sane_perplexity(F.lit(float("inf"))),
        N.cost(F.lit(6321217), F.lit(2804994), F.lit(0.75), F.lit(4.5)),
    ).first()
    assert list(r) == pytest.approx([0.4082482905, 0, 2.4e-05, 1.0, 2.4494897428, 1.0, 17.363386])
    assert (N.metric_name("tpr", 0.001), N.metric_name("f1", 0.0001), N.metric_name("f1", 0.01)) == ("tpr_at_0_1pct_fpr", "f1_at_0_01pct_fpr", "f1_at_1pct_fpr")


def test_allocation(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 7), ("c", 3)], "g string, n long")
    assert {r.g: r.take for r in S.allocate(counts, "g", F.lit(9)).collect()} == {"a": 5, "b": 3, "c": 1}
    even = spark.createDataFrame([("x", 5), ("y", 5), ("z", 5)], "g string, n long")
    assert {r.g: r.take for r in S.allocate(even, "g", F.lit(4)).collect()} == {"x": 2, "y": 1, "z": 1}


def test_sampling_errors_and_preserved(spark):
    df = spark.range(50).withColumn("g", (F.col("id") % 3).cast("string"))
    with pytest.raises(ValueError, match="fewer than 17"):
        S.sample_per_group(df, "g", 17, "id")
    with pytest.raises(ValueError, match="not in the data"):
        S.sample_total(df, 10, "id", preserved=spark.range(49, 52))
    kept = {r.id for r in S.sample_total(df, 10, "id", preserved=spark.range(5)).collect()}
    assert len(kept) == 10 and set(range(5)) <= kept


def test_splits_are_disjoint_and_repeatable(spark):
    rows = [("p1", "t1"), ("p1", "t2"), ("p2", "t2"), *[(f"q{i}", f"u{i % 40}") for i in range(60)]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, p string, t string")
    grouped = S.group_components(df, "p", "t")
    assert len({r.group_id for r in grouped.filter("id < 3").collect()}) == 1
    groups = grouped.groupBy("group_id").agg(F.lit("s").alias("stratum"))
    split = S.group_splits(groups, "group_id", "stratum", 0.2, 0.1)
    first = {r.group_id: r.split for r in split.collect()}
    again = {r.group_id: r.split for r in S.group_splits(groups.repartition(5), "group_id", "stratum", 0.2, 0.1).collect()}
    n = len(first)
    sizes = [list(first.values()).count(s) for s in ("test", "val", "train")]
    assert first == again and sizes[0] == math.ceil(0.2 * n) and sizes[1] == math.ceil(0.125 * (n - sizes[0]))
    joined = grouped.join(split, "group_id").withColumn("label", F.col("t"))
    assert Q.check_integrity(joined, "split", F.col("p"), F.col("t"), "label", deduplicated=False)["conflicting_texts"] == 0


def test_integrity_gate_raises(spark):
    df = spark.createDataFrame([("train", "p", "t", "a"), ("test", "p", "u", "a"), ("test", "q", "u", "b")], "split string, p string, t string, label string")
    with pytest.raises(ValueError, match="several labels"):
        Q.check_integrity(df, "split", F.col("p"), F.col("t"), "label")


def test_samples(spark):
    df = spark.createDataFrame([(0, " finance ", "What  is x?", ["A.", " "], ["B", "C  c"]), (1, "", None, [], None)], "row long, source string, question string, human_answers array<string>, chatgpt_answers array<string>")
    rows = R.to_samples(df, "row", "hc3").orderBy("label", "text").collect()
    assert [(r.domain, r.prompt, r.label, r.text) for r in rows] == [("finance", "What is x?", "ai", "B"), ("finance", "What is x?", "ai", "C c"), ("finance", "What is x?", "human", "A.")]
    assert rows[0].asDict().keys() == dict.fromkeys(R.SAMPLE_COLUMNS).keys() and len({r.sample_id for r in rows}) == 3


def test_fallback_and_chain(spark):
    full = F.expr("map(1, 'A', 2, 'B', 3, 'C')")
    case = lambda m, depth, score: spark.range(1).select(W.selected_depth(m, depth, 3, F.lit(score), 3).alias("d")).select("d", W.selected_text(m, F.lit("o"), F.col("d"))).first()
    assert [tuple(case(full, 3, 2)), tuple(case(full, 3, 3)), tuple(case(F.expr("map(3, 'C')"), 3, 2)), tuple(case(full, 2, 2))] == [(2, "B"), (3, "C"), (0, "o"), (2, "B")]
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "sample_id string, text string")
    done = W.run_chain(df.filter("sample_id = 'a'"), lambda: lambda t: t + "!", 2)
    assert sorted((r.sample_id, r.depth, r.text) for r in done.collect()) == [("a", 1, "x!"), ("a", 2, "x!!")]
    assert {r.sample_id for r in W.run_chain(df, lambda: str.upper, 2, done).collect()} == {"b"}


def test_positions_and_lookup(spark):
    a = spark.createDataFrame([(i * 3, f"a{i}") for i in range(40)], "x long, u string").repartition(5)
    b = spark.createDataFrame([(i * 7, f"b{i}") for i in range(40)], "y long, v string").repartition(3)
    assert all(r.u[1:] == r.v[1:] for r in Q.join_by_position(a, b, "x", "y").collect())
    rows = spark.createDataFrame([("1", "k"), ("2", "k"), ("3", "m"), ("4", "n")], "id string, key string")
    ids, keys = spark.createDataFrame([("1", "by id")], "id string, v string"), spark.createDataFrame([("k", "K"), ("m", "M1"), ("m", "M2")], "key string, v string")
    assert {r.id: r.v for r in Q.two_level_lookup(rows, ids, keys, "id", ["key"], "v").collect()} == {"1": "by id", "2": "K", "3": None, "4": None}


def test_char_ngrams(spark):
    assert one(spark, "ab  c", lambda c: X.char_ngrams(c, 3, 5)) == [" ab", "ab ", " ab ", " c "]


def test_perplexities_of_documents_and_sentences_without_tokens(spark):
    docs = spark.createDataFrame([(1, "aa bb. cc aa!"), (2, None), (3, ""), (4, "? a."), (5, "aa bb. ?! cc aa.")], "doc_id long, text string")
    model = X.unigram_model(docs, X.word_tokens(X.fold(F.col("text"))))
    got = {r.doc_id: r for r in X.sentence_perplexities(docs, "doc_id", "text", model).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for i in (2, 3, 4):
        assert tuple(got[i])[1:] == (1.0, 1.0, 0.0, 0.0)
    assert got[5].doc_perplexity == pytest.approx(got[1].doc_perplexity)
    assert got[5].sentence_perplexity_mean == pytest.approx((2 * got[1].sentence_perplexity_mean + 1) / 3)
    assert got[5].burstiness == pytest.approx(got[5].sentence_perplexity_std / got[5].sentence_perplexity_mean)
