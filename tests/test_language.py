"""The language model against plain Python over whole vocabularies."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievewright.operators import language as L

D = L.DISCOUNT


class Plain:
    def __init__(self, docs, order, vocabulary=None):
        self.order = order
        self.vocabulary = vocabulary or {w for d in docs if len(d) > 1 for w in d}
        tri = Counter((d[i - 2] if i > 1 else None, d[i - 1], d[i]) for d in docs for i in range(1, len(d)))
        two = Counter()
        for (_, v, w), n in tri.items():
            two[v, w] += 1 if order == 3 else n
        one = Counter(w for _, w in two)
        self.three = {k: n for k, n in tri.items() if k[0] is not None}
        self.two, self.one = two, one

    def p1(self, w):
        total, size = sum(self.one.values()), len(self.vocabulary) + 1
        even = D * len(self.one) / total / size
        return max(self.one.get(w, 0) - D, 0) / total + even

    def p(self, context, w):
        if not context:
            return self.p1(w)
        table = self.three if len(context) == 2 else self.two
        after = {k[-1]: n for k, n in table.items() if k[:-1] == context}
        if not after:
            return self.p(context[1:], w)
        total = sum(after.values())
        return max(after.get(w, 0) - D, 0) / total + D * len(after) / total * self.p(context[1:], w)


def windowed(doc, model, max_length, stride):
    """Total and number of log-probabilities, window after window."""
    total, n, done = 0.0, 0, 0
    stride = min(stride, max_length)
    for begin in range(0, len(doc), stride):
        end = min(len(doc), begin + max_length)
        for i in range(max(done, begin + 1), end):
            context = tuple(doc[max(begin, i - model.order + 1) : i])
            total -= math.log(model.p(context, doc[i]))
            n += 1
        done = max(done, end)
    return total, n


def corpus(seed, n=25, longest=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    return [[rng.choices(words, [1 / (k + 1) for k in range(12)])[0] for _ in range(rng.randint(0, longest))] for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "id long, t array<string>").repartition(3)


@pytest.mark.parametrize("order, max_length, stride", [(3, 1000, 500), (3, 10, 4), (3, 6, 6), (3, 5, 9), (2, 7, 3), (3, 2, 1), (3, 1, 1)])
def test_perplexity_over_windows(spark, order, max_length, stride):
    docs = corpus(order + max_length)
    model = Plain(docs, order)
    got = {r.id: (r.tokens, r.perplexity) for r in L.kn_perplexity(frame(spark, docs), "id", F.col("t"), order, max_length, stride).collect()}
    for i, d in enumerate(docs):
        total, n = windowed(d, model, max_length, stride)
        assert got[i][0] == n and got[i][1] == pytest.approx(math.exp(total / n) if n else 1.0, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = corpus(5)
    model = L.fit_backoff(L.window_grams(frame(spark, docs), "id", F.col("t")), 2)
    words = model.words.collect()
    assert sum(r.p1 for r in words) + model.unknown == pytest.approx(1)
    grid = spark.createDataFrame([(v.w, w.w) for v in words[:4] for w in words] + [(7, w.w) for w in words], "v long, w long")
    for r in L.pair_probabilities(grid, model).groupBy("v").agg(F.sum("p").alias("s")).join(model.backs, "v", "left").collect():
        back = 1.0 if r.back is None else r.back
        assert r.s + back * model.unknown == pytest.approx(1)


def test_ratio_and_entropy_over_the_whole_vocabulary(spark):
    a, b = corpus(8, 12), corpus(9, 12, 15) + [["only", "here", "w1"]]
    both = a + b
    grams = L.window_grams(frame(spark, both), "id", F.col("t"))
    vocabulary = L.vocabulary_of(grams)
    observer = L.fit_backoff(grams.filter(f"id < {len(a)}"), 2, vocabulary)
    performer = L.fit_backoff(grams.filter(f"id >= {len(a)}"), 2, vocabulary)
    names = {w for d in both if len(d) > 1 for w in d}
    plain_o, plain_p = Plain(a, 2, names), Plain(b, 2, names)
    everything = [*sorted(names), "unknown"]

    def ce(o, p, v):
        return -sum(o.p((v,), w) * math.log(p.p((v,), w)) for w in everything)

    got = {r.id: r for r in L.perplexity_ratio(grams, observer, performer, "id").collect()}
    entropy = {r.id: r.entropy for r in L.predicted_entropies(grams, observer, "id").collect()}
    for i, d in enumerate(both):
        if len(d) < 2:
            assert i not in got and i not in entropy
            continue
        n = len(d) - 1
        nll = -sum(math.log(plain_p.p((d[k - 1],), d[k])) for k in range(1, len(d))) / n
        cross = sum(ce(plain_o, plain_p, d[k - 1]) for k in range(1, len(d))) / n
        assert (got[i].tokens, got[i].nll, got[i].cross_entropy, got[i].ratio) == pytest.approx((n, nll, cross, nll / cross))
        assert entropy[i] == pytest.approx(sum(ce(plain_o, plain_o, d[k - 1]) for k in range(1, len(d))) / n)


def test_empty(spark):
    df = frame(spark, [[], ["a"]])
    assert {(r.id, r.tokens, r.perplexity) for r in L.kn_perplexity(df, "id", F.col("t")).collect()} == {(0, 0, 1.0), (1, 0, 1.0)}
    with pytest.raises(ValueError):
        L.fit_backoff(df, 4)


@pytest.mark.parametrize("small", [False, True])
def test_rows_under_their_own_models(spark, monkeypatch, small):
    from sievewright.operators import contexts as C

    if small:  # many pieces, buckets and merges, and a file
        for name, value in (("PIECE", 30), ("BUCKET", 40), ("HELD", 1), ("SCORED", 20), ("WAITING", 10)):
            monkeypatch.setattr(C, name, value)
    docs = corpus(21, 40) + [["only", "here"], ["w1", "w1"], ["lonely"]]
    df = frame(spark, docs)
    grams = L.window_grams(df, "id", F.col("t"), 10, 4)
    vocabulary = L.vocabulary_of(grams)
    models = [L.fit_backoff(grams.filter(F.col("id") % 2 == m), 2, vocabulary) for m in (0, 1)]
    want = {r.id: tuple(r) for r in L.perplexity_ratio(grams, *models, "id").collect()}
    got = L.own_ratio(df, "id", F.col("t"), F.col("id") % 2, 10, 4)
    assert {r.id: pytest.approx(tuple(r)) for r in got.collect()} == want
    want = {r.id: tuple(r) for r in L.predicted_entropies(grams, L.fit_backoff(grams, 2), "id").collect()}
    assert {r.id: pytest.approx(tuple(r)) for r in L.own_entropies(df, "id", F.col("t"), 10, 4).collect()} == want
    for order in (2, 3):
        want = {r.id: (r.tokens, r.perplexity) for r in L.perplexities(grams, L.fit_backoff(grams, order), "id").collect()}
        got = {r.id: (r.tokens, pytest.approx(r.perplexity)) for r in L.kn_perplexity(df, "id", F.col("t"), order, 10, 4).collect()}
        assert got == {i: want.get(i, (0, 1.0)) for i in range(len(docs))}


def test_grams_meet_no_join(spark, monkeypatch):
    from sievewright.operators import contexts as C

    plans = []
    monkeypatch.setattr(C, "stored", lambda df, name, f=C.stored: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or f(df, name))
    L.kn_perplexity(frame(spark, corpus(3)), "id", F.col("t"), 3, 10, 4).collect()
    assert sum(p.count("Join") for _, p in plans) == 1 and not any("Generate" in p for _, p in plans)  # only sums meet their keys
