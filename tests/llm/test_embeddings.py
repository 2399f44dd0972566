"""Near-duplicate vectors against all cosines."""

import numpy as np

from sievewright.llm import embeddings as E

from .test_jaccard import components_of


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.9:
                links.append((i, j))
    count = {i: 0 for i, _ in rows}
    for i, j in links:
        count[i] += 1
        count[j] += 1
    found = components_of([i for i, _ in rows if i is not None], links)
    return {i: (count[i], found.get(i)) for i, _ in rows}


def run(spark, rows):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, name string")
    found = E.near_duplicates(df).collect()
    assert len(found) == len(rows) and all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in found)
    return {r.vec_id: (r.n_links, r.component_id) for r in found}


def test_clusters_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 60)):
            rows.append((len(rows) * 3, [float(x) for x in np.float32(centre + 0.12 * rng.standard_normal(32))]))
    rows += [(9000 + i, rows[0][1]) for i in range(40)]
    nan, inf = float("nan"), float("inf")
    rows += [(9500, None), (9501, []), (9502, [0.0] * 32), (9503, [nan] * 32), (9504, [inf] + [1.0] * 31), (9505, [None, 1.0]), (9506, [1.0, 2.0]), (9507, [1.0, 2.0]), (9508, [1e-30] * 32), (9509, [1e30] * 32), (None, [1.0, 2.0])]
    got, want = run(spark, rows), brute(rows)
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.01 * len(want), [(i, got[i], want[i]) for i in wrong[:5]]
    assert all(got[i] == want[i] for i in want if i is None or i >= 9500)


def test_recall_by_band_of_cosine(spark):
    rng = np.random.default_rng(3)
    rows, planted = [], {}
    for low, high in ((0.85, 0.9), (0.9, 0.91), (0.91, 0.95), (0.95, 1.0)):
        for _ in range(250):
            u = rng.standard_normal(64)
            u /= np.linalg.norm(u)
            w = rng.standard_normal(64)
            w -= (w @ u) * u
            c = rng.uniform(low, high)
            v = c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)
            planted[len(rows)] = (low, len(rows) + 1)
            rows += [(len(rows) + k, [float(x) for x in np.float32(x * rng.uniform(0.1, 9))]) for k, x in enumerate((u, v))]
    got, want = run(spark, rows), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    for low in (0.9, 0.91, 0.95):
        pairs = [i for i, (b, j) in planted.items() if b == low and want[i][0]]
        assert len(pairs) > 200 and sum(got[i][0] == want[i][0] for i in pairs) >= 0.99 * len(pairs), low
    assert not any(got[i][0] for i, (b, j) in planted.items() if b == 0.85 and not want[i][0])


def test_an_id_with_two_vectors(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(3, x), (5, [1.0, 0.01, 0.0]), (5, y), (7, [0.0, 1.0, 0.01]), (7, [0.0, 1.0, 0.02]), (9, [0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect())
    assert found == [(3, 1, 3), (5, 1, 3), (5, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9)]


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
