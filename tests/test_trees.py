"""Boosted trees against plain Python ones on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.operators import trees as T


def table(spark, rows):
    """rows: (id, y, validation, {place: weight})"""
    own = spark.createDataFrame([r[:3] for r in rows], "id long, y int, validation boolean")
    weights = spark.createDataFrame([(r[0], p, w) for r in rows for p, w in r[3].items()], "id long, place int, weight double")
    return own.repartition(3), weights.repartition(5)


def split(rows, grads, config, top):
    """The best split of these rows by trying every one; ``top`` has each place's largest weight, above which nothing ends."""
    g, h = sum(grads[r[0]][0] for r in rows), sum(grads[r[0]][1] for r in rows)
    best = None
    for place in sorted({p for r in rows for p in r[3]}):
        for cut in sorted({r[3][place] for r in rows if place in r[3]}):
            for missing in (False, True):
                left = [r for r in rows if (missing if place not in r[3] else r[3][place] <= cut)]
                lg, lh = sum(grads[r[0]][0] for r in left), sum(grads[r[0]][1] for r in left)
                if lh < config.least or h - lh < config.least:
                    continue
                gain = lg**2 / (lh + config.penalty) + (g - lg) ** 2 / (h - lh + config.penalty) - g**2 / (h + config.penalty)
                if gain > T.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                    best = gain, place, cut, missing, left
    return best and (*best[:2], math.inf if best[2] == top[best[1]] else best[2], *best[3:]), g, h


def boost(rows, config):
    train = [r for r in rows if not r[2]]
    ones = sum(r[1] for r in train)
    margin = {r[0]: math.log(ones / (len(train) - ones)) for r in rows}
    gains, losses = [], []
    top = {p: max(r[3][p] for r in train if p in r[3]) for p in {p for r in train for p in r[3]}}
    for _ in range(config.rounds):
        p = {i: 1 / (1 + math.exp(-m)) for i, m in margin.items()}
        grads = {r[0]: (p[r[0]] - r[1], p[r[0]] * (1 - p[r[0]])) for r in rows}
        own = {}

        def grow(number, inside, everyone, depth):
            best, g, h = split(inside, grads, config, top) if depth else (None, sum(grads[r[0]][0] for r in inside), sum(grads[r[0]][1] for r in inside))
            if best is None:
                for r in everyone:
                    margin[r[0]] -= config.rate * g / (h + config.penalty)
                return
            gain, place, cut, missing, left = best
            own[number] = gain
            goes = lambda r: missing if place not in r[3] else r[3][place] <= cut
            grow(2 * number + 1, left, [r for r in everyone if goes(r)], depth - 1)
            grow(2 * number + 2, [r for r in inside if not goes(r)], [r for r in everyone if not goes(r)], depth - 1)

        grow(0, train, rows, config.depth)
        gains.append(own)
        held = [math.log1p(math.exp(margin[r[0]])) - r[1] * margin[r[0]] for r in rows if r[2]]
        losses.append(sum(held) / len(held) if held else None)
    return margin, gains, losses


def sample(seed, n=160, places=9, validation=0.2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = {p: round(rng.random(), 2) for p in range(places) if rng.random() < (0.3 if p else 0.9)}
        y = int(w.get(0, 0.4) + (0.5 if 3 in w else 0) + rng.gauss(0, 0.3) > 0.7)
        rows.append((i * 7, y, rng.random() < validation, w))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = sample(seed)
    config = T.TreeConfig(rounds=12, depth=3, rate=0.3, rows=1.1, places=1.0, patience=50, bins=256)
    own, weights = table(spark, rows)
    forest = T.fit_forest(own, weights, 9, config)
    margin, gains, losses = boost(rows, config)
    assert [sorted(t.gains) for t in forest.trees] == [sorted(g) for g in gains]
    for t, g in zip(forest.trees, gains, strict=True):
        assert t.gains == pytest.approx(g, rel=1e-5, abs=1e-5)
    assert [held for _, held in forest.losses] == pytest.approx(losses, abs=1e-5)
    lists = weights.groupBy("id").agg(F.collect_list("place").alias("p"), F.collect_list("weight").alias("w"))
    got = T.forest_margin(own.join(lists, "id", "left"), forest, F.col("p"), F.col("w")).collect()
    assert {r.id: r.margin for r in got} == pytest.approx(margin, abs=1e-4)
    again = T.Forest.from_dict(forest.to_dict())
    assert again == forest


def test_does_not_depend_on_partitions(spark):
    own, weights = table(spark, sample(5, 300))
    config = T.TreeConfig(rounds=5, depth=4)
    one = T.fit_forest(own, weights, 9, config)
    other = T.fit_forest(own.repartition(1), weights.repartition(11, "place"), 9, config)
    assert one.to_dict()["trees"] == other.to_dict()["trees"]


def test_bins_are_quantiles(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(2000)] + [0.5] * 500
    weights = spark.createDataFrame([(i, 4, v) for i, v in enumerate(values)] + [(i, 5, float(i % 3)) for i in range(90)], "id long, place int, weight double")
    rows = T.with_cuts(weights, 16).collect()
    cuts = sorted({r.cut for r in rows if r.place == 4})
    assert 12 <= len(cuts) <= 16 and cuts[-1] == math.inf and {r.cut for r in rows if r.place == 5} == {0.0, 1.0, math.inf}
    for r in rows:
        if r.place == 4:
            assert r.cut == min(c for c in cuts if c >= values[r.id])
    sizes = [sum(r.cut == c for r in rows if r.place == 4) for c in cuts]
    assert all(s < 2500 / 16 + 2 for c, s in zip(cuts, sizes, strict=True) if c not in (min(c for c in cuts if c >= 0.5),))


def test_early_stopping_and_samples(spark):
    rng = random.Random(11)
    rows = [(i, rng.randint(0, 1), i % 3 == 0, {p: rng.random() for p in range(4)}) for i in range(200)]  # nothing to learn
    own, weights = table(spark, rows)
    forest = T.fit_forest(own, weights, 4, T.TreeConfig(rounds=40, patience=3))
    assert len(forest.trees) == forest.best_round + 3 < 40
    chosen = T.places_of_round(1000, 0.8, 42, 3)
    assert chosen.sum() == 800 and (chosen != T.places_of_round(1000, 0.8, 42, 4)).any()
    share = (T.uniform(T.np.arange(20_000), 42, 2, 0) < 0.8).mean()
    assert abs(share - 0.8) < 0.02


def test_defined_cases(spark):
    none = spark.createDataFrame([], "id long, place int, weight double")
    empty = T.fit_forest(spark.createDataFrame([], "id long, y int, validation boolean"), none, 3)
    assert (empty.start, empty.trees) == (0.0, [])
    own = spark.createDataFrame([(1, 1, None), (2, 1, False)], "id long, y int, validation boolean")
    assert T.fit_forest(own, none, 3).start == 20.0
    both = spark.createDataFrame([(1, 1, None), (2, 0, False), (3, 0, False)], "id long, y int, validation boolean")
    forest = T.fit_forest(both, none, 3, T.TreeConfig(rounds=2, rows=1.1))
    assert len(forest.trees) == 2 and all(not t.splits and set(t.values) == {0} for t in forest.trees)


def test_entries_are_packed(spark):
    rng = T.np.random.default_rng(3)
    codes = T.Codes(70_001, 256, 3)
    places, bins, counts = rng.choice(7_000, 500, replace=False), rng.integers(0, 257, 500), T.np.array([200, 0, 300])
    made = T.Block.made(False, T.np.arange(3), T.np.zeros(3), counts, places, bins, codes)
    batch = made.batch()
    again = T.Block.of(batch, 0, codes)
    assert (again.code == made.code).all() and (again.row == made.row).all()
    assert sum(len(batch[c][0].as_buffer()) for c in ("step", "row")) < 500 * 5 + 100  # four bytes an entry, steps that do not fit beside them
    dense = again.dense(T.np.sort(places), 70_001)
    row = T.np.repeat(T.np.arange(3), counts)
    assert all(dense[r, T.np.searchsorted(T.np.sort(places), p)] == b for r, p, b in zip(row, places, bins, strict=True)) and T.np.isnan(dense).sum() == 1000
    v = T.np.array([0, -1, 2**31, -(2**40), 2**31 - 1])
    assert (T.unpacked(T.pa.scalar(T.packed(v, T.np.int32), T.pa.binary()), T.np.int32) == v).all()


def test_a_level_is_one_row_for_a_task_and_bucket(spark):
    own, weights = table(spark, sample(7, 300))
    codes = T.Codes(9, 256, 4)
    work, cuts = T.training_blocks(own, weights, codes)
    assert work.count() <= 2 * 4 and cuts.count() > 100
    start = [T.Tree(values={0: 0.0})]
    found, (g, h, loss, held) = T._level(work, start, T.Tree(), None, codes, T.TreeConfig(rows=1.1), 0)
    y = [r[1] for r in sample(7, 300) if not r[2]]
    assert (g / T.UNIT, h / T.UNIT) == (len(y) / 2 - sum(y), len(y) / 4) and loss == held == pytest.approx(math.log(2)) and len(found) == 1


@pytest.mark.parametrize("held", [1 << 28, 0])
def test_tasks_side_by_side_give_the_trees_of_the_other_way(spark, monkeypatch, held):
    monkeypatch.setattr(T, "HELD", held)
    rows = sample(13, 400) + [(10_000 + i, i % 2, False, {}) for i in range(5)]
    own, weights = table(spark, rows)
    config = T.TreeConfig(rounds=25, depth=4, bins=16)
    asked = []
    monkeypatch.setattr(T, "slots", lambda s: asked.append(s) or 3)
    one = T.fit_forest(own, weights, 9, config)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("forest", "")
    T.fit_forest(own, weights, 9, config)
    assert len(tracker.getJobIdsForGroup("forest")) < 25  # fewer jobs than rounds
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(T, "slots", lambda s: 0)
    other = T.fit_forest(own, weights, 9, config)
    assert asked and one.trees == other.trees and len(one.trees) == 25 and one.best_round == other.best_round
    assert [x for pair in one.losses for x in pair] == pytest.approx([x for pair in other.losses for x in pair])
