"""Perturbation rounds against plain Python."""

import hashlib
import math

from pyspark.sql import functions as F

from sievewright.operators import perturb as B


def starts(n, share, *key):
    ranked = sorted((hashlib.md5("|".join(map(str, [*key, i])).encode()).hexdigest(), i) for i in range(n // 4))
    return sorted(i * 4 + 1 for _, i in ranked[: math.floor(share * n / 4)])


def plain(key, copy, text, rounds, seed, tries, ok):
    attempts = spans = given_up = 0
    for turn in range(rounds):
        w = text.split(" ")
        for attempt in range(tries):
            at = starts(len(w), 0.3, seed, turn, attempt, key, copy)
            attempts += 1
            if not at:
                break
            if ok(attempt, key, copy):
                for k, a in reversed(list(enumerate(at))):
                    w[a : a + 2] = [f"f{k} g"]
                text, spans = " ".join(w), spans + len(at)
                break
        else:
            given_up += 1
    return text, attempts, spans, given_up


def test_rounds(spark):
    def fill(df):
        good = (F.col("attempt") * 7 + F.col("key") * 3 + F.col("copy")) % 5 == 0
        few = F.transform("starts", lambda a, i: F.concat(F.lit("f"), i.cast("string"), F.lit(" g")))
        return df.withColumn("fills", F.when(good, few).when(F.col("key") % 2 == 0, F.slice(few, F.lit(1), F.greatest(F.size(few) - 1, F.lit(0)))))  # too few, or null

    texts = [(i, " ".join(f"w{j}" for j in range(i * 3 % 50))) for i in range(30)] + [(31, None)]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    for rounds, tries in ((1, 20), (3, 3)):
        rows = B.perturb(df, "id", "t", fill, copies=2, rounds=rounds, seed=5, tries=tries).collect()
        assert len(rows) == 62
        for r in rows:
            want = plain(r.id, r.copy, dict(texts)[r.id] or "", rounds, 5, tries, lambda a, k, c: (a * 7 + k * 3 + c) % 5 == 0)
            assert (r.text, r.attempts, r.spans, r.given_up) == want
    assert any(r.given_up for r in rows)


def test_random_fills(spark):
    df = spark.createDataFrame([(1, "a b c d " * 10), (2, "a"), (3, "x <extra_id_5> y z w v u t " * 3)], "id long, t string")
    rows = {r.id: r for r in B.perturb(df, "id", "t", B.random_fills(["p", "q", "r"], 2, 9), seed=1).collect()}
    assert rows[2].text == "a" and (rows[2].spans, rows[2].attempts) == (0, 1)
    w = rows[1].text.split(" ")
    assert len(w) == len(("a b c d " * 10).split(" ")) and rows[1].spans > 0 and sum(x in "pqr" for x in w if x) == 2 * rows[1].spans
    assert "<extra_id_" not in rows[3].text and rows[3].given_up == 0
    assert rows[1].text == B.perturb(df, "id", "t", B.random_fills(["p", "q", "r"], 2, 9), seed=1).filter("id = 1").head().text
