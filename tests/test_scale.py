"""Operators whose work is dealt over tasks, against plain Python."""

import gzip
import json
import lzma
import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources import item, write
from triagegrid.operators import live, ml, ranking, rows
from triagegrid.operators.features import Encoder, base_features, poc_flags
from triagegrid.plans import backtest
from triagegrid.sources import feeds, scans


@pytest.mark.parametrize("values", [[random.Random(1).gauss(0, 1) for _ in range(900)], [5] * 700 + [1, 9, None]])
def test_selection_finds_places_of_the_order(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    order = sorted(float(v) for v in values if v is not None)
    places = [len(order) // 3, len(order) - 1, len(order)]
    assert rows.kth_smallest(df, "v", places, enough=200) == [*(order[p] for p in places[:2]), None]
    middle = order[(len(order) - 1) // 2], order[len(order) // 2]
    assert rows.exact_median(df, "v") == sum(middle) / 2


def test_median_of_nothing(spark):
    assert rows.exact_median(spark.createDataFrame([], "v double"), "v") is None


def test_running_sums_in_two_steps_equal_one(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), rng.gauss(0, 1), 0.5]), rng.randint(0, 1)) for _ in range(800)]
    df = spark.createDataFrame(data, "k string, s double, y int")
    key = lambda r: (r["k"] or "", r["score"])
    one, two = (sorted(ranking.tied_blocks(df, "s", "y", by=["k"], parts=p).collect(), key=key) for p in (0, 7))
    assert one == two and len(one) > 150
    assert ranking.tied_blocks(df.limit(0), "s", "y").count() == 0


def test_shares_of_lower_values(spark):
    data = [("a", v) for v in (1.0, 2.0, 2.0, None, 5.0)] + [("b", 1.0)]
    df = spark.createDataFrame(data, "k string, v double").withColumn("n", F.lit(1))
    got = sorted(((r["k"], r["v"], round(r["percentile"], 3)) for r in ranking.cume_dist(df, "v", ["k"]).collect()), key=str)
    assert got == sorted([("a", None, 0.2), ("a", 1.0, 0.4), ("a", 2.0, 0.8), ("a", 2.0, 0.8), ("a", 5.0, 1.0), ("b", 1.0, 1.0)], key=str)


def test_records_by_year(spark, tmp_path):
    (tmp_path / "CVE-2020.json").write_text(json.dumps({"cve_items": [item("CVE-2020-1")]}))
    (tmp_path / "CVE-2020.json.gz").write_bytes(gzip.compress(json.dumps({"cve_items": [item("CVE-2020-2")]}).encode()))
    (tmp_path / "CVE-2021.json.xz").write_bytes(lzma.compress(json.dumps({"CVE_Items": [{"cve": item("CVE-2021-1")}, item("CVE-2021-2")]}).encode()))
    (tmp_path / "CVE-2022.json").write_text(json.dumps([item("CVE-2022-1")]))
    path = f"file://{tmp_path}"
    assert {r["cve"] for r in feeds.read_records(spark, path, feeds.years("2019-2021")).collect()} == {"CVE-2020-2", "CVE-2021-1", "CVE-2021-2"}
    with pytest.raises(ValueError):
        feeds.read_records(spark, path, [1999])


def test_components_of_any_depth(spark, tmp_path):
    inner = None
    for i in range(12, -1, -1):
        inner = {"name": f"c{i}", "version": "1", **({"components": [inner]} if inner else {})}
    comps, _, _ = scans.read_bom(spark, write(tmp_path / "b.json", {"components": [inner]}))
    assert [r["name"] for r in comps.orderBy("ord").collect()] == [f"c{i}" for i in range(13)]
    assert scans.read_bom(spark, write(tmp_path / "e.json", {"components": []}))[0].count() == 0


def test_live_feeds_go_before_the_snapshot(spark):
    snap = spark.createDataFrame([("a", 0.1, True), ("b", 0.2, False)], "cve string, epss double, kev boolean")
    now = spark.createDataFrame([("a", 0.9)], "cve string, epss double")
    listed = spark.createDataFrame([("b",), ("b",)], "cve string")
    told = lambda df: {tuple(r[c] for c in ("cve", "epss", "epss_source", "kev", "kev_source")) for r in df.collect()}
    # An id that the live scores leave out has 0; without live scores the snapshot's stays.
    assert told(live.override(snap, now, listed)) == {("a", 0.9, "live", False, "live"), ("b", 0.0, "live", True, "live")}
    assert told(live.override(snap)) == {("a", 0.1, "snapshot", True, "snapshot"), ("b", 0.2, "snapshot", False, "snapshot")}
    wanted = spark.createDataFrame([("b",), ("new",), ("new",)], "cve string")
    assert told(live.override(snap, now, listed, wanted=wanted)) == {("b", 0.0, "live", True, "live"), ("new", 0.0, "live", False, "live")}
    again = spark.createDataFrame([("a", 0.9, 1), ("a", 0.3, 2)], "cve string, epss double, at int")
    assert [r[1] for r in sorted(told(live.override(snap, again, order="at")))] == [0.3, 0.0]


def features(spark):
    data = [(f"CVE-2020-{1000 + i}", "x" * (i % 7), f"CWE-{i % 3}", f"v{i % 4}", f"v{i % 4}:p{i % 9}", i % 5 == 0) for i in range(160)]
    df = spark.createDataFrame(data, "cve string, description string, cwe string, vendor string, product string, y boolean")
    more = [F.lit(None).cast("string").alias("cvss_vector"), F.lit(5.0).alias("cvss_base"), F.lit("2020-05-05").cast("timestamp").alias("published")]
    from triagegrid.operators.features import REFERENCES

    return poc_flags(base_features(df.select("*", *more, *[F.lit(0).alias(c) for c in REFERENCES]))).withColumn("y", F.col("y").cast("int"))


def test_encoder_comes_back_from_its_tables(spark, tmp_path):
    df = features(spark)
    made = Encoder(df, "y")
    made.save(f"file://{tmp_path}/enc")
    again = Encoder.load(spark, f"file://{tmp_path}/enc")
    assert again.names() == made.names() and again.prior == made.prior
    pick = lambda e: {(r["cve"], r["vendor_kev_rate"], r["product_kev_rate"]) for r in e.transform(df).collect()}
    assert pick(again) == pick(made)


def test_first_trees_are_a_prefix_of_the_ensemble(spark):
    df = features(spark)
    enc = Encoder(df, "y")
    x = enc.transform(df)
    model = ml.fit_trees(x, x, enc.names(), "y", rounds=4, step=0.1, depth=2, least=5)
    whole = model.stages[-1]
    assert 1 <= len(whole.treeWeights) <= 4
    rows_ = model.stages[0].transform(x).select("cve", "features", "y").cache()
    one = ml.first_trees(whole, 1)
    got = [round(r["rawPrediction"][1], 9) for r in one.transform(rows_).orderBy("cve").collect()]
    tree = whole.trees[0].copy({whole.trees[0].predictionCol: "t"}).transform(rows_)
    assert got == [round(r["t"] * whole.treeWeights[0], 9) for r in tree.orderBy("cve").collect()] and len(one.treeWeights) == 1
    precision = ml.prefix_precision(whole, rows_, "y")
    assert sorted(precision) == list(range(1, len(whole.treeWeights) + 1)) and all(0 <= v <= 1 for v in precision.values())


def test_headline_compares_the_formula_with_severity(spark):
    df = spark.createDataFrame([("x", "ml", 0.25), ("x", "cvss", 0.75), ("x", "epss", 0.5)], "case string, ranker string, effort_90 double")
    assert [tuple(r) for r in backtest.headline(df).collect()] == [("x", 0.25, 0.75, 0.5)]
