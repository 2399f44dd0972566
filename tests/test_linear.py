"""The squared hinge fit against plain descent on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import linear as L


def rows_of(spark, x, y, weight):
    lists = [(int(a), float(b), [int(p) for p in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r, a, b in zip(x, y, weight, strict=True)]
    return spark.createDataFrame(lists, "y int, weight double, places array<int>, weights array<double>").repartition(3)


@pytest.mark.parametrize("c", [1.0, 30.0])
def test_reaches_the_optimum(spark, c):
    rng = np.random.default_rng(4)
    x = rng.random((80, 7)) * (rng.random((80, 7)) < 0.5)
    y = (x[:, 0] - x[:, 3] + rng.normal(0, 0.2, 80) > 0).astype(int)
    weight = np.where(y == 1, 2.0, 0.5)
    rows = rows_of(spark, x, y, weight)
    model = L.fit_squared_hinge(rows, 7, c)
    full, s = np.hstack([x, np.ones((80, 1))]), 2 * y - 1

    def judged(w):
        short = np.maximum(0, 1 - s * (full @ w))
        return w @ w / 2 + c * (weight * short**2).sum(), w - 2 * c * full.T @ (weight * s * short)

    w = np.zeros(8)
    rate = 1 / (1 + 2 * c * np.linalg.norm(full * np.sqrt(weight)[:, None], 2) ** 2)
    ahead, speed = w, 1.0
    for _ in range(30_000):  # accelerated descent
        before, faster = w, (1 + np.sqrt(1 + 4 * speed**2)) / 2
        w = ahead - rate * judged(ahead)[1]
        ahead, speed = w + (speed - 1) / faster * (w - before), faster
    own = np.append(model.weights, model.constant)
    assert judged(own)[0] == pytest.approx(model.loss) and judged(own)[0] <= judged(w)[0] * (1 + 1e-6)
    assert own == pytest.approx(w, abs=1e-3)
    got = [r.margin for r in L.linear_margin(rows, model).orderBy("y", "places", "weights").collect()]
    assert sorted(got) == pytest.approx(sorted(full @ own), abs=1e-9)


def test_defined_cases(spark):
    none = L.fit_squared_hinge(rows_of(spark, np.zeros((0, 3)), [], []), 3)
    assert not none.weights.any() and none.constant == 0
    blank = L.fit_squared_hinge(rows_of(spark, np.zeros((4, 3)), [1, 1, 1, 0], np.ones(4)), 3)
    assert not blank.weights.any() and blank.constant == pytest.approx(2 * 2 / (1 + 2 * 4), abs=1e-6)


def test_rows_are_read_once_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.random((60, 9)) * (rng.random((60, 9)) < 0.4)
    x[11] = 0
    y = (x[:, 1] > x[:, 2]).astype(int)
    rows, read = rows_of(spark, x, y, np.ones(60)), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    whole = L.fit_squared_hinge(rows.mapInArrow(seen, rows.schema), 9)
    assert whole.passes > 3 and read.value == 60
    # blocks of a row or two, and sums that are added up in tasks first
    monkeypatch.setattr(L, "BLOCK", 5)
    monkeypatch.setattr(L, "PARTS", 1)
    packed = L._packed(rows.select(F.lit(1.0).alias("s"), "weight", "places", "weights"))
    assert 15 < packed.count() < 60
    cut = L.fit_squared_hinge(rows, 9)
    assert cut.loss == pytest.approx(whole.loss, abs=1e-9) and np.append(cut.weights, cut.constant) == pytest.approx(np.append(whole.weights, whole.constant), abs=1e-6)


@pytest.mark.parametrize("held", [1 << 28, 0])
def test_tasks_side_by_side_take_the_same_steps(spark, monkeypatch, held):
    rng = np.random.default_rng(9)
    x = rng.random((70, 8)) * (rng.random((70, 8)) < 0.4)
    x[5] = 0
    y = (x[:, 1] > x[:, 2]).astype(int)
    rows = rows_of(spark, x, y, np.ones(70))
    monkeypatch.setattr(L, "BLOCK", 20)
    monkeypatch.setattr(L, "HELD", held)
    spark.sparkContext.setJobGroup(f"hinge {held}", "")
    one = L.fit_squared_hinge(rows, 8)
    assert one.passes > 12 and len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"hinge {held}")) < 8  # not a job a pass
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(L, "slots", lambda s: 0)
    other = L.fit_squared_hinge(rows, 8)
    assert one.loss == pytest.approx(other.loss, rel=1e-12) and one.weights == pytest.approx(other.weights, abs=1e-6)
