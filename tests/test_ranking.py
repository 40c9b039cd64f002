import random

import pytest

from triagegrid.operators import ranking


def truth(pairs, k):
    """Mean hits among the first k over shuffles of tied rows."""
    rng, total = random.Random(1), 0
    for _ in range(3000):
        rows = sorted(((-s, rng.random(), y) for s, y in pairs))
        total += sum(y for *_, y in rows[:k])
    return total / 3000


def test_ties_against_shuffles(spark):
    rng = random.Random(5)
    pairs = [(float(rng.randint(0, 4)), rng.randint(0, 1)) for _ in range(40)]
    b = ranking.tied_blocks(spark.createDataFrame(pairs, "s double, y int"), "s", "y")
    for k in (1, 7, 20, 40):
        assert b.agg(ranking.expected_hits(k).alias("x")).first()["x"] == pytest.approx(truth(pairs, k), abs=0.12)


def test_hand_values(spark):
    df = spark.createDataFrame([(1.0, int(i == 0)) for i in range(10)], "s double, y int")
    r = ranking.tied_blocks(df, "s", "y").agg(ranking.expected_hits(5).alias("h"), ranking.mean_rank().alias("m"), ranking.precision_at(2).alias("p"), ranking.roc_auc().alias("a")).first()
    assert (r["h"], r["m"], r["a"]) == (0.5, 5.5, 0.5) and r["p"] == pytest.approx(0.1)


def test_two_steps_equal_one_and_nan_comes_last(spark):
    rng = random.Random(9)
    rows = [(float(rng.randint(0, 60)), rng.randint(0, 1)) for _ in range(500)] + [(float("nan"), 1), (None, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    one = sorted(map(tuple, ranking.tied_blocks(df, "s", "y").collect()))
    two = sorted(map(tuple, ranking.tied_blocks(df, "s", "y", parts=8).collect()))
    assert one == two and one[0][0] == float("-inf") and one[0][3] == 500


def test_no_positives_and_empty(spark):
    none = ranking.report(ranking.tied_blocks(spark.createDataFrame([(1.0, 0)], "s double, y int"), "s", "y")).first()
    assert none["roc_auc"] is None and none["recall_1000"] is None and none["effort_90"] is None
    assert ranking.tied_blocks(spark.createDataFrame([], "s double, y int"), "s", "y").count() == 0


def test_effort_without_ties_is_sequential(spark):
    rng = random.Random(3)
    for _ in range(3):
        ys = [int(rng.random() < 0.3) for _ in range(30)] + [1]
        df = spark.createDataFrame([(float(-i), y) for i, y in enumerate(ys)], "s double, y int")
        got = ranking.report(ranking.tied_blocks(df, "s", "y")).first()["effort_90"]
        need, seen = -(-sum(ys) * 9 // 10), 0
        for i, y in enumerate(ys, 1):
            seen += y
            if seen >= need:
                break
        assert got == pytest.approx(i / len(ys))
