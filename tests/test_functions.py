import math

import pytest
from pyspark.sql import functions as F

from triagegrid.functions import cvss, numbers, text
from triagegrid.operators import scoring


@pytest.mark.parametrize("scope,c,i,a,want", [("C", "H", "H", "H", 6.0), ("U", "H", "H", "H", 5.9), ("U", "N", "N", "H", 3.6), ("U", "H", "H", "N", 5.2), ("C", "L", "L", "N", 2.7)])
def test_impact(spark, scope, c, i, a, want):
    df = spark.createDataFrame([(f"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:{scope}/C:{c}/I:{i}/A:{a}",)], "v string")
    row = df.select(cvss.impact(cvss.parsed(F.col("v"))).alias("x"), cvss.scope_changed(cvss.parsed(F.col("v"))).alias("s")).first()
    assert row["x"] == want and row["s"] == (scope == "C")


def test_vectors_that_do_not_parse(spark):
    good = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    rows = [(None, False), ("", False), (good, True), ("cvss:3.0/" + good.lower(), True), ("CVSS:2.0/" + good, False), (good + "/E:P", True), (good.replace("AC:L", "AC:X"), False), (good[:-4], False), (good + "/A:N", True)]
    got = spark.createDataFrame(rows, "v string, ok boolean").withColumn("p", cvss.parsed(F.col("v"))).collect()
    assert [r["p"] is not None for r in got] == [r["ok"] for r in got]
    assert got[-1]["p"]["a"] == "N"  # of a metric given twice the last counts


def test_rounding_and_ceiling(spark):
    r = spark.range(1).select(numbers.half_up(F.lit(0.285), 2).alias("a"), numbers.soft_ceiling(F.lit(90.0)).alias("b"), numbers.soft_ceiling(F.lit(150.0)).alias("c"), numbers.sigmoid(F.lit(99.0)).alias("d")).first()
    assert r["a"] == 0.28 and r["b"] == 90.0 and 99 < r["c"] < 100 and r["d"] == 1 / (1 + math.exp(-35))


def test_keys_of_addresses_and_cpes(spark):
    df = spark.createDataFrame([(" PKG:npm/A@1?x=1#y", "cpe:/a:v:prod:1.0"), ("", "cpe:2.3:a:v:prod:*:*")], "p string, c string")
    product, version = text.cpe_product_version(F.col("c"))
    got = df.select(text.purl_key(F.col("p")).alias("k"), product.alias("pr"), version.alias("ve")).collect()
    assert tuple(got[0]) == ("pkg:npm/a@1", "prod", "1.0") and tuple(got[1]) == (None, "prod", None)


FINDING = "cvss_base double, cvss_impact double, scope_changed boolean, p_model double, epss double, kev boolean, poc_github boolean, poc_exploitdb boolean, maturity_override string, fanin long, max_fanin long, has_context boolean, services " + scoring._SERVICES


def one(name, tier, crit, net=False):
    return (name, tier, crit, net, False, [], [])


def test_legacy_formula_by_hand(spark):
    services = [one("a", 1, "Critical"), one("b", 1, "Critical"), one("c", 1, "Critical"), one("d", 2, "High")]
    s = spark.createDataFrame([(9.8, 6.0, True, 0.5, 0.975, True, False, False, None, 1, 1, True, services)], FINDING).select(scoring.legacy().alias("s")).first()["s"]
    assert (s["likelihood"], s["blast_radius"], s["impact"], s["risk"]) == (0.9838, 0.8, 0.9, 96.93)


def test_multiplier_and_ablation(spark):
    rows = [
        (9.8, 6.0, True, 0.5, 0.9, True, False, False, None, 1, 2, False, []),
        (9.8, 6.0, True, 0.5, 0.9, True, False, False, None, 1, 2, True, []),
        (9.8, 6.0, True, 0.5, 0.9, True, False, False, None, 1, 2, True, [one("a", 3, "Medium"), one("b", 2, "High", True)]),
    ]
    df = spark.createDataFrame(rows, FINDING)
    got = df.select(scoring.combined().alias("s"), scoring.combined(("kev",)).alias("k")).collect()
    assert [r["s"]["crit_mult"] for r in got] == [1.0, 1.25, 1.5]
    assert got[0]["s"]["likelihood"] == pytest.approx(0.5 * 0.5 + 0.3 * 0.9 + 0.2, abs=1e-12)
    assert got[0]["s"]["raw"] == pytest.approx(100 * 0.72 * 0.75 * 1.15, abs=1e-9)
    assert got[0]["k"]["likelihood"] == pytest.approx(0.52, abs=1e-12)
