import os

import numpy as np

from triagegrid.llm import covertree


def shuffled(spark) -> dict[str, int]:
    """The shuffle files that stand in the session's local folders, with their bytes."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{d}/{n}": os.path.getsize(f"{d}/{n}") for top in tops for d, _, names in os.walk(top.getPath()) for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_leaves_do_not_travel_with_their_pairs(spark, monkeypatch):
    """Vectors far apart, so that every leaf meets every other: what is shuffled stays in proportion to the rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x[700] = x[3] * 2 + 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    df.count()
    monkeypatch.setattr(covertree, "BLOCK", 100)
    seen, before = {}, shuffled(spark)
    real = covertree.materialize
    monkeypatch.setattr(covertree, "materialize", lambda *a, **k: (real(*a, **k), seen.update(shuffled(spark)))[0])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.links(spark, df).collect()}
    assert got == {i: (1, 3) if i in (3, 700) else (0, i) for i in range(1500)}
    assert 0 < sum(n for f, n in seen.items() if f not in before) < 6 * x.nbytes
