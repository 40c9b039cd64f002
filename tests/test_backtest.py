import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from triagegrid.operators import asof, boosting, features, nested, rates
from triagegrid.plans import backtest, training

VECTORS = ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:C/C:L/I:N/A:N", None]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows, listed, now, then, poc = [], [], [], [], []
    for i in range(900):
        cve, year = f"CVE-{rng.randint(2019, 2023)}-{1000 + i}", rng.randint(2019, 2023)
        bad = rng.random() < 0.25
        published = dt.datetime(year, rng.randint(1, 12), rng.randint(1, 28))
        rows.append((cve, "unauthenticated remote code execution" if bad and rng.random() < 0.8 else "a small issue", published, VECTORS[0 if bad else rng.randint(1, 2)], 9.8 if bad else 4.0, 5.9 if bad else 2.0, rng.choice(["CWE-79", "CWE-89", "noinfo"]), rng.choice("abc"), rng.choice("abc") + ":x", *[rng.randint(0, 3)] * 8))
        if bad and rng.random() < 0.7:
            listed.append((cve, published + dt.timedelta(days=rng.randint(1, 900))))
        if rng.random() < 0.9:
            then.append((cve, rng.random() * (0.9 if bad else 0.3), 0.5))
        now.append((cve, 0.1, 0.5))
        if rng.random() < 0.3:
            poc.append((cve, published + dt.timedelta(days=rng.randint(-5, 90), hours=10)))
    cols = "cve string, description string, published timestamp, cvss_vector string, cvss_base double, cvss_impact double, cwe string, vendor string, product string, " + ", ".join(f"{c} int" for c in features.REFERENCES)
    make = spark.createDataFrame
    base = features.base_features(make(rows, cols), make(poc, "cve string, first_ts timestamp"))
    return features.feature_table(base, make(listed, "cve string, kev_date_added timestamp"), make(now, "cve string, epss double, percentile double"), make(then, "cve string, epss double, percentile double")).cache()


def test_windows_and_the_freeze(table):
    at = F.lit("2022-06-01").cast("timestamp")
    rows = features.poc_flags(table, at).select("published", "poc_github_first", "poc_github").collect()
    for r in rows:
        limit = min(r["published"] + dt.timedelta(days=30), dt.datetime(2022, 6, 1))
        assert r["poc_github"] == int(r["poc_github_first"] is not None and r["poc_github_first"] <= limit)


def test_nothing_in_the_matrix_tells_the_label(table):
    enc = features.Encoder(table.withColumn("y", F.col("kev_date_added").isNotNull().cast("int")), "y")
    banned = ("kev_date", "cisa", "epss", "published", "days_since")
    assert not [n for n in enc.names() if any(b in n for b in banned)]
    with pytest.raises(ValueError):
        enc.transform(table)


def test_backtest(spark, table, tmp_path):
    at = F.lit("2023-01-01").cast("timestamp")
    scores = backtest.frozen_scores(spark, table, at, folds=2, trees=False)
    intel = backtest.frozen_intel(table, scores, at).cache()
    assert intel.count() == table.count() and intel.where("kev and exploited_later").count() == 0
    pop = backtest.population(intel, at)
    out = backtest.evaluate(pop)
    by = {r["ranker"]: r for r in out["all"].collect()}
    assert set(by) == {"cvss", "legacy", "ml", "epss", "model"} and by["model"]["roc_auc"] > 0.7
    assert {r["ranker"] for r in out["open"].collect()} == set(by)
    ablation = {r["ranker"]: r for r in out["ablation"].collect()}
    assert ablation["full"]["delta"] == 0.0 and len(ablation) == 7 and ablation["asset"]["effort_90"] is None and ablation["fanin"]["delta"] is None and ablation["epss"]["effort_90"] is not None
    seen = pop.select("epss", F.col("exploited_later").cast("int").alias("y")).collect()
    low = [r["y"] for r in seen if r["epss"] <= min(x["epss"] for x in seen) + 1e-12]
    assert tuple(out["floor"].first())[2:] == (len(low), len(low) / len(seen), sum(low))
    curve = sorted((r["point"], r["worked"], r["covered"]) for r in out["curves"].where("ranker = 'model'").collect())
    assert [c[0] for c in curve] == list(range(200)) and curve[0][2] == 0.0 and curve[-1][1:] == (1.0, 1.0) and all(a[2] <= b[2] for a, b in zip(curve, curve[1:]))
    first = backtest.top_findings(pop.withColumn("rank", F.lit(1)), 3).collect()
    assert [r["exploited_later"] for r in first] == [True] * 3
    backtest.write_ablation(out["ablation"], f"{tmp_path}/a.csv")
    backtest.write_shards(intel, f"{tmp_path}/shards")
    shard = backtest.read_shards(spark, f"{tmp_path}/shards").where("id_year = 2021")
    assert shard.count() == table.where("cve like 'CVE-2021-%'").count() and shard.where("poc_github and poc_mask % 2 = 0").count() == 0


SMALL = boosting.Settings(rounds=12, step=0.3, leaves=4, least=20, patience=10)


def test_frozen_scores_of_trees_are_those_of_fold_by_fold(spark, table):
    at = F.lit("2023-01-01").cast("timestamp")
    scores = {r["cve"]: r["p_model"] for r in backtest.frozen_scores(spark, table, at, folds=2, settings=SMALL).collect()}
    assert len(scores) == table.count() and all(0 <= p <= 1 for p in scores.values())
    rows = features.poc_flags(table, at).withColumn("y", asof.known(F.col("kev_date_added"), at).cast("int")).withColumn("split", asof.frozen_split_of(F.col("published"), at))
    rows = rows.withColumn("f", rates.fold_of(F.col("cve"), 2)).withColumn("g", rates.fold_of(F.col("cve"), seed=43)).cache()
    # Fold 0 by itself: its rows are not there when the model of the others is made, so that model is the one of all rows.
    others = rows.where("split <> 'train' or split is null or f <> 0").withColumn("f", F.lit(0))
    alone = nested.matrix(others, "y", "split", "f", "g", 1).where("model = 1").withColumn("key", F.xxhash64("cve")).cache()
    model = boosting.fit(spark, alone.where("role <> 'score'"), SMALL)
    line = boosting.platt(boosting.score(alone.where("role = 'validation'").drop("key"), model))[1]
    together = nested.matrix(rows, "y", "split", "f", "g", 2).where("model = 0 and role = 'score'")
    held = boosting.score(together.withColumn("model", F.lit(1)), model).collect()
    assert len(held) == rows.where("split = 'train' and f = 0").count() > 50
    for r in held:
        assert abs(scores[r["cve"]] - 1 / (1 + math.exp(-(line[0] * r["margin"] + line[1])))) < 1e-9


def test_no_model_knows_the_rows_that_it_scores(spark, table):
    rows = table.withColumn("y", F.col("kev_date_added").isNotNull().cast("int")).withColumn("split", F.when(F.year("published") < 2022, "train").when(F.year("published") == 2022, "validation"))
    rows = features.poc_flags(rows).withColumn("f", rates.fold_of(F.col("cve"), 3)).withColumn("g", rates.fold_of(F.col("cve"), seed=43)).cache()
    at = nested.feature_names().index("vendor_kev_rate")
    get = lambda df: {(r["model"], r["role"], r["cve"]): r["x"] for r in nested.matrix(df, "y", "split", "f", "g", 3).collect()}
    before = get(rows)
    one = rows.where("split = 'train' and y = 1").select("cve", "f", "g", "vendor").first()
    after = get(rows.withColumn("y", F.when(F.col("cve") == one["cve"], 0).otherwise(F.col("y"))))
    # Its label is not in its own row for any model, nor in any row of the model that scores it.
    assert set(before) == set(after)
    changed = {k for k in before if before[k] != after[k]}
    assert changed and not [k for k in changed if k[2] == one["cve"] and k[1] == "train"] and not [k for k in changed if k[0] == one["f"]]
    brute = rows.where(f"split = 'train' and f <> 1 and vendor = '{one['vendor']}'").agg(F.sum("y"), F.count("y")).first()
    prior = rows.where("split = 'train' and f <> 1").agg(F.avg("y")).first()[0]
    want = (brute[0] + 20 * prior) / (brute[1] + 20)
    some = rows.where(f"split = 'train' and f = 1 and vendor = '{one['vendor']}'").first()["cve"]
    assert abs(before[1, "score", some][at] - want) < 1e-12


def test_training_run_with_trees(spark, table):
    run = training.train(spark, table, F.lit("2024-01-01").cast("timestamp"), years=(2019, 2021), validation_year=2022, test_year=2023, settings=SMALL._replace(rounds=10))
    got = {r["ranker"]: r for r in run.table.collect()}
    assert set(got) == {"cvss", "epss", *training.VARIANTS, "logreg_no_epss"}
    n = table.where("year(published) = 2023").count()
    assert all(r["n"] == n for r in got.values()) and got["model_no_epss"]["roc_auc"] > 0.7
    assert all(r["n"] == table.where("year(published) = 2023 and cvss_missing = 0").count() for r in run.scored.collect())
    assert set(run.lines) == set(run.models) == {*training.VARIANTS, "logreg_no_epss"} and all(a > 0 for a, _ in run.lines.values())
    assert len(run.importance) == 15 and run.importance[0][1] > 0 and run.contributions.count() == 15
    assert run.contributions.first()["feature"] in dict(run.importance)
    with pytest.raises(ValueError, match="test"):
        training.train(spark, table, F.lit("2024-01-01").cast("timestamp"), years=(2019, 2021), validation_year=2022, test_year=2030, trees=False)


def test_gate():
    assert backtest.gate(0.9, False, True) == [] and len(backtest.gate(0.7, True, False)) == 3
