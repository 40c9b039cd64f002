"""Steps whose work must not grow faster than their input."""

import io
import json

from pyspark.sql import functions as F

from triagegrid.functions import cvss, numbers
from triagegrid.operators import correlate as C
from triagegrid.operators import rows
from triagegrid.plans import queries as core
from triagegrid.plans import source_queries as sources
from triagegrid.sources import ranges

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_id_lists_hold_all_ids(spark):
    """a list for each reason."""
    want = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_returnflag", "l_suppkey").collect():
        want.setdefault(r[0], set()).add(str(r[1]))
    assert {r["reason"]: r["ids"] for r in core.distinct_id_lists(spark, SF).collect()} == {k: ",".join(sorted(v)) for k, v in want.items()}


def test_median_makes_its_input_once(spark):
    """a join before a median runs once, however many passes narrow it down."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(3001).select((F.col("id") * 7 % 1501).cast("double").alias("v")).mapInArrow(count, "v double")
    values = sorted(i * 7 % 1501 for i in range(3001))
    assert rows.exact_median(df, "v", enough=100) == values[1500] and made.value == 3001
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (None, 9), (5.0, 4)], "v double, n int")
    assert rows.exact_median(weighted, "v", "n") == 3.5


def test_vectors_are_split_once(spark):
    """the work on a vector does not grow with its metrics."""
    df = spark.createDataFrame([("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H\n",), (" a:h /AV:N/ac:L/PR:N/UI:N/S:U/C:H/I:H/x/A: L:",), ("A:L/I:N/C:H/S:C/UI:R/PR:H/AC:H/AV:P/A:N",)], "v string")
    out = df.select(cvss.parsed(F.col("v")).alias("p"))
    assert _plan(out).count("split(") == 1
    assert [r["p"] and "".join(r["p"]) for r in out.collect()] == [None, None, "PHHRCHNN"]


def test_rounding_takes_decimals_for_large_values_only(spark):
    """doubles are enough below 2**51, at both sides of it the result is exact."""
    values = [0.5, 1.5, 2.5, 0.125, 2.675, 0.0049999999999999, 0.005, 0.015625, 63.984375, 2.0**51 - 0.5, 2.0**51 + 0.5, 22517998136852.475, 22517998136852.48, -0.375, -2.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 5):
        out = df.select("v", numbers.half_even(F.col("v"), digits).alias("r"))
        assert all(r["r"] == round(r["v"], digits) for r in out.collect())
        assert "2.251799813685248E15" in _plan(out)


def test_findings_without_a_key_are_dealt_over_all_tasks(spark):
    """a missing reference, address or version does not bring all findings into one task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.range(4000).select(
            F.col("id").alias("finding_ord"), F.when(F.col("id") == 7, "r1").otherwise("").alias("bom_ref"), F.when(F.col("id") == 8, "?x").otherwise("").alias("purl"),
            F.lit("a").alias("pkg_name"), F.when(F.col("id") == 9, "1").alias("pkg_version"), F.lit("CVE-1").alias("cve_id"),
        )
        comp = spark.createDataFrame([(0, "r1", "a", "", "1", "?y", 0, "direct")], "ord int, bom_ref string, name string, `group` string, version string, purl string, dependency_depth int, dependency_type string")
        out = C.correlate(found, comp)
        assert {r["finding_ord"]: r["match"] for r in out.where("match is not null").collect()} == {7: "bom-ref", 8: "purl", 9: "name@version"}
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_documents_share_files(spark):
    """the number of stored files does not follow the number of applications."""
    docs = sources._portfolio_boms(spark, SF)
    assert docs.count() >= 20 and len(docs.inputFiles()) <= 4


def test_services_are_looked_up_once_per_component(spark):
    """findings of one component share a lookup, whatever their CVE; nulls count as equal."""
    f = spark.range(300).select(F.concat(F.lit("f"), "id").alias("finding_id"), F.lit("r").alias("component_ref"), F.lit("lib").alias("component_name"), F.lit("1").alias("version"), F.lit("").alias("component_purl"), F.lit(None).cast("string").alias("component_group"), F.lit(None).cast("string").alias("host"))
    services = spark.createDataFrame([(0, "web", 1, "Critical", True, False, ["lib"], [])], "service_ord int, name string, tier int, criticality string, internet_facing boolean, handles_pii boolean, components array<string>, hosts array<string>")
    comp = spark.createDataFrame([(0, "r", "lib")], "ord int, bom_ref string, name string")
    closure = spark.createDataFrame([("r", "r")], "node string, ancestor string")
    hits = C.services_of(f, services, closure, comp, spark.createDataFrame([], "root_ref string, root_name string"))
    got = hits.select("finding_id", F.col("services")[0]["name"].alias("s")).collect()
    assert len(got) == 300 and {r["s"] for r in got} == {"web"}
    # Only the last join, back to the findings, has their ids.
    assert _plan(hits).count("AS finding_id") == 1


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """F8, F9, F10: few bytes say what ranges there are, but reading them is many tasks' work, and a small range reads little beyond its end."""
    (tmp_path / "a.json").write_text(json.dumps([{"id": f"CVE-{i}", "x": "y" * 90} for i in range(4000)]))
    found = ranges.read_records(spark, f"file://{tmp_path}", split=8192)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert [len(c) for c in ranges._chunks(io.BytesIO(b"x" * 10000), 0, None, 4096)] == [4096, 4096, 1808]
