import itertools
import math

import numpy as np
import pytest

from triagegrid.operators import boosting as B

ROWS = "model int, role string, key long, x array<double>, y int"


def planted(n=1500, seed=3, models=(0,)):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 5, n), rng.normal(size=n)], 1)
    p = 1 / (1 + np.exp(-(2 * x[:, 1] * (x[:, 0] > 0.3) - 2 + 0.7 * (x[:, 2] == 3))))
    y = (rng.random(n) < p).astype(int)
    return [(m, "train" if i % 3 else "validation", i, x[i].tolist(), int(y[i])) for m in models for i in range(n)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, ROWS).repartition(parts)


def test_a_tree_is_the_one_that_best_first_growth_gives(spark):
    rows = planted()
    s = B.Settings(rounds=1, leaves=6, least=30, row_share=1.0, column_share=1.0)
    got = B.fit(spark, frame(spark, rows), s)[0]
    train = [r for r in rows if r[1] == "train"]
    x, y = np.array([r[3] for r in train]), np.array([r[4] for r in train])
    edges = B.bin_edges(frame(spark, rows), {0: 4}, s.bins)[0]
    pos = (len(y) - y.sum()) / y.sum()
    p0 = y.mean()
    w = np.where(y == 1, pos, 1.0)
    g, h = (p0 - y) * w, p0 * (1 - p0) * w
    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)

    def split(m):
        found = [(worth(m & (x[:, f] <= e)) + worth(m & (x[:, f] > e)) - worth(m), f, e) for f in range(4) for e in edges[f] if min((m & (x[:, f] <= e)).sum(), (m & (x[:, f] > e)).sum()) >= s.least]
        return max(found, default=(0.0, 0, 0.0), key=lambda t: t[0])

    leaves = [np.ones(len(y), bool)]
    while len(leaves) < 6:
        best = max(range(len(leaves)), key=lambda i: split(leaves[i])[0])
        gain, f, e = split(leaves[best])
        m = leaves.pop(best)
        leaves += [m & (x[:, f] <= e), m & (x[:, f] > e)]
    want = np.full(len(y), math.log(p0 / (1 - p0)))
    for m in leaves:
        want[m] -= s.step * g[m].sum() / (h[m].sum() + 1.0)
    assert np.allclose(got.margin(x), want, atol=1e-6) and len(got.trees) == 1
    assert sorted(got.trees[0].cover[got.trees[0].feature < 0]) == sorted(m.sum() for m in leaves)


@pytest.fixture(scope="module")
def fitted(spark):
    s = B.Settings(rounds=30, step=0.3, leaves=6, least=20, patience=6)
    rows = planted(models=(0, 1))
    # The second model has a part of the first one's rows.
    rows = [r for r in rows if r[0] == 0 or r[1] == "validation" or r[2] % 5]
    return s, rows, B.fit(spark, frame(spark, rows), s)


def test_models_are_left_when_they_stop_to_improve(fitted):
    s, rows, models = fitted
    for m in models.values():
        best = int(np.argmax(m.precision))
        assert len(m.trees) == best + 1 and len(m.precision) == m.fitted
        # Looked at every EVERY rounds, so at most that much later than patience says.
        assert m.fitted == s.rounds or best + 1 + s.patience <= m.fitted < best + 1 + s.patience + B.EVERY
    x, y = (np.array([r[i] for r in rows if r[0] == 0 and r[1] == "validation"]) for i in (3, 4))
    f = models[0].margin(x)
    assert f[y == 1].mean() > f[y == 0].mean() + 0.2
    gains = models[0].gains()
    assert gains.shape == (4,) and np.isclose(gains.sum(), sum(t.gain.sum() for t in models[0].trees)) and gains[1] > 0


def test_together_or_alone_and_however_dealt_models_are_the_same(spark, fitted):
    s, rows, models = fitted
    alone = B.fit(spark, frame(spark, [r for r in rows if r[0] == 1], 3), s)[1]
    assert alone.fitted == models[1].fitted and len(alone.trees) == len(models[1].trees)
    for a, b in zip(alone.trees, models[1].trees):
        assert all(np.array_equal(p, q) for p, q in zip(a, b))


def test_contributions_are_shapley_values_of_the_trees(spark, fitted):
    s, rows, models = fitted
    m = models[0]._replace(trees=models[0].trees[:3])
    x = np.array([r[3] for r in rows[:40]])

    def value(tree, row, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        kids = tree.left[node], tree.right[node]
        if f in known:
            return value(tree, row, known, kids[0] if row[f] <= tree.at[node] else kids[1])
        return sum(tree.cover[k] / tree.cover[node] * value(tree, row, known, k) for k in kids)

    got = m.contributions(x)
    for row, phi in zip(x, got):
        for j in range(4):
            others = [f for f in range(4) if f != j]
            want = sum(math.factorial(len(c)) * math.factorial(3 - len(c)) / 24 * sum(value(t, row, {*c, j}) - value(t, row, set(c)) for t in m.trees) for n in range(4) for c in itertools.combinations(others, n))
            assert abs(phi[j] - want) < 1e-9
    assert np.allclose(got.sum(1) + m.expected(), m.margin(x))


def test_scores_in_spark_equal_those_of_the_model(spark, fitted):
    _, rows, models = fitted
    some = rows[:60] + [(1, "score", 9, [None, 1.0, None, 0.0], 0), (7, "score", 10, [0.0] * 4, 0)]
    got = {(r["model"], r["key"]): r for r in B.score(frame(spark, some), models, contributions=True).collect()}
    for m, _, key, x, _ in some:
        r = got[m, key]
        if m == 7:
            assert r["margin"] is None and r["contributions"] is None
        else:
            v = np.array([[-np.inf if a is None else a for a in x]])
            assert abs(r["margin"] - models[m].margin(v)[0]) < 1e-12 and abs(sum(r["contributions"]) + models[m].expected() - r["margin"]) < 1e-9
    assert B.score(frame(spark, []), models).count() == 0
    with pytest.raises(Exception, match="4 numbers"):
        B.score(frame(spark, [(0, "score", 1, [1.0], 0)]), models).collect()


def test_models_come_back_from_their_tables(spark, fitted, tmp_path):
    _, _, models = fitted
    B.save(spark, models, {0: (0.5, -1.0)}, f"file://{tmp_path}/m")
    back, lines = B.load(spark, f"file://{tmp_path}/m")
    assert lines == {0: (0.5, -1.0), 1: (1.0, 0.0)} and set(back) == set(models)
    for m in models:
        assert back[m][0] == models[m].start and back[m].fitted == models[m].fitted and back[m].precision == models[m].precision and back[m].width == models[m].width
        assert all(np.array_equal(p, q) for a, b in zip(back[m].trees, models[m].trees, strict=True) for p, q in zip(a, b))


def test_one_class_is_an_error(spark):
    with pytest.raises(ValueError):
        B.fit(spark, frame(spark, [(0, "train", i, [1.0], 0) for i in range(9)]))


def test_platt_finds_the_likeliest_line(spark):
    rng = np.random.default_rng(2)
    f = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(1.7 * f - 0.6)))).astype(int)
    rows = [(0, float(a), int(b)) for a, b in zip(f, y)] + [(1, 0.3, 1), (1, 0.2, 1)]
    got = B.platt(spark.createDataFrame(rows, "model int, margin double, y int"))
    assert got[1] == (1.0, 0.0)
    a, b = got[0]
    p = 1 / (1 + np.exp(-(a * f + b)))
    assert abs(((p - y) * f).sum()) < 1e-3 and abs((p - y).sum()) < 1e-3 and abs(a - 1.7) < 0.5
