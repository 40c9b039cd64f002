"""Live feeds over HTTP, advisory archives, version order, shards by run-time pruning, importance and published states."""

import datetime as dt
import functools
import http.server
import json
import random
import re
import threading
import urllib.parse
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagegrid.functions import versions
from triagegrid.operators import boosting, importance
from triagegrid.plans import backtest, sinks
from triagegrid.sources import advisories, feed_service


class Service(http.server.BaseHTTPRequestHandler):
    asked: list = []
    failures = 0

    def do_GET(self):
        at = urllib.parse.urlparse(self.path)
        ids = urllib.parse.parse_qs(at.query).get("cve", [""])[0].split(",")
        Service.asked.append(len(ids))
        broken = at.path == "/down" or (at.path == "/partly" and "CVE-7" in ids)
        if at.path == "/shaky" and Service.failures > 0:
            Service.failures -= 1
            broken = True
        if at.path == "/list":
            body = {"vulnerabilities": [{"cveID": "CVE-1"}, {"cveID": " CVE-1 "}, {"cveID": "CVE-2"}]}
        else:
            body = {"data": [{"cve": i, "epss": str(int(i[4:]) / 1000)} for i in ids if int(i[4:] or 0) % 3]}
        self.send_response(500 if broken else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_live_scores_are_whole_or_none(spark, service):
    wanted = spark.createDataFrame([(f"CVE-{i}",) for i in range(1, 251)] * 2 + [(None,)], "cve string").repartition(1)
    ask = functools.partial(feed_service.live_scores, spark, wanted, pause=0.01)
    Service.asked.clear()
    got = {r["cve"]: r["epss"] for r in ask(f"{service}/ok?cve={{ids}}").collect()}
    assert got == {f"CVE-{i}": i / 1000 if i % 3 else 0.0 for i in range(1, 251)}
    assert max(Service.asked) <= 100 and sum(Service.asked) == 250
    Service.failures = 2
    assert ask(f"{service}/shaky?cve={{ids}}", tries=4).count() == 250
    assert ask(f"{service}/partly?cve={{ids}}", tries=1) is None and ask("http://127.0.0.1:1/?{ids}", tries=1) is None
    assert feed_service.live_scores(spark, wanted.where("false"), f"{service}/ok?cve={{ids}}").count() == 0


def test_the_first_list_that_answers_counts(spark, service):
    assert sorted(r["cve"] for r in feed_service.live_listed(spark, [f"{service}/down", f"{service}/list"]).collect()) == ["CVE-1", "CVE-2"]
    assert feed_service.live_listed(spark, [f"{service}/down", f"{service}/ok?cve=CVE-1"]) is None


def python_key(v):
    return [(0, int(p)) if re.fullmatch("[0-9]+", p) else (1, p) for p in re.split(r"[.\-+_]", v)]


def test_versions_order_as_their_parts(spark):
    rng = random.Random(3)
    part = lambda: rng.choice([str(rng.randint(0, 30)), "0" + str(rng.randint(0, 9)), str(rng.randint(10**20, 10**21)), "a", "final", "B2", "", "é", "10x"])
    every = ["".join(part() + rng.choice(".-+_") for _ in range(rng.randint(0, 3))) + part() for _ in range(1000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(every)], "v string, i int")
    got = [r["v"] for r in df.orderBy(versions.version_key(F.col("v")), "i").collect()]
    assert got == sorted(every, key=python_key)
    lists = [rng.sample(every, rng.randint(0, 6)) + rng.choice([[], ["99-RC1", "98.beta", "97-SNAPSHOT", ""]]) for _ in range(60)] + [["1.0", "1-0"], None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>").select("i", versions.highest_version(F.col("v")).alias("h")).collect()
    for r in rows:
        some = [v for v in lists[r["i"]] or [] if v and not re.search("(alpha|beta|rc|snapshot|dev)", v, re.I)]
        assert r["h"] == (sorted(some, key=python_key)[-1] if some else None)


def advisory(i, cve, day, versions_=(), eco="PyPI", introduced=None):
    ranges = [{"events": [{"introduced": "0"}, {"introduced": introduced}]}] if introduced else []
    return {"id": f"G-{i}", "aliases": [cve, "CVE-X", cve], "published": f"{day}T00:00:00Z", "affected": [{"package": {"ecosystem": "npm", "name": "no"}, "versions": ["9"]}, {"package": {"ecosystem": f"{eco}:3", "name": f"p{i}"}, "versions": list(versions_), "ranges": ranges}]}


def test_advisories_of_an_archive(spark, tmp_path):
    docs = [advisory(0, "CVE-1", "2023-01-01", ["1.9", "1.10", "2.0rc1"]), advisory(1, "CVE-2", "2024-05-05", ["3"]), advisory(2, "CVE-3", "2023-01-01", [], introduced="4.5"), advisory(3, "CVE-1", "2023-01-01", []), advisory(4, "CVE-9", "2023-01-01", ["1"]), {"id": "CVE-4", "affected": [{"package": {"ecosystem": "PyPI", "name": "own"}, "versions": ["7"]}]}]
    for n, kind in (("a", zipfile.ZIP_DEFLATED), ("b", zipfile.ZIP_STORED)):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", kind) as z:
            for i, d in enumerate(docs):
                z.writestr(f"dir/{n}{i}.json", json.dumps(d))
            z.writestr("broken.json", "{nope")
            z.writestr("readme.txt", "no advisory")
    bodies = advisories.read_members(spark, f"file://{tmp_path}", group=1)
    assert bodies.count() == 2 * (len(docs) + 1)
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert {r["member"]: r["body"] for r in bodies.where("path like '%a.zip'").collect()} == {n: z.read(n).decode() for n in z.namelist() if n.endswith(".json")}
    targets = spark.createDataFrame([(f"CVE-{i}",) for i in (1, 2, 3, 4)], "cve string")
    one = bodies.where("path like '%a.zip'")
    rows, late = advisories.scan(one, targets, "PyPI", "2024-01-01")
    assert sorted(map(tuple, rows.collect())) == [("PyPI", "own", "7", "CVE-4"), ("PyPI", "p0", "1.10", "CVE-1"), ("PyPI", "p2", "4.5", "CVE-3")] and late.first()["late"] == 1
    known = spark.createDataFrame([("CVE-2", "2020-01-01"), ("CVE-4", "2025-01-01"), ("CVE-1", "")], "cve string, day string")
    rows, late = advisories.scan(one, targets, "PyPI", "2024-01-01", known)
    assert sorted(r["cve"] for r in rows.collect()) == ["CVE-1", "CVE-2", "CVE-3"] and late.first()["late"] == 1
    assert [tuple(r)[1:] for r in advisories.top_packages(advisories.scan(bodies, targets, "PyPI")[0], 2).collect()] == [("own", "7", 1), ("p0", "1.10", 1)]
    assert advisories.scan(one, targets, "PyPI")[0].count() == 4 and advisories.scan(one, targets, "Go")[0].count() == 0


def test_only_the_shards_of_the_findings_years_are_read(spark, tmp_path):
    intel = spark.range(4000).select(
        F.concat(F.lit("CVE-"), (2015 + F.col("id") % 8).cast("string"), F.lit("-"), (1000 + F.col("id")).cast("string")).alias("cve"), F.lit(0.123456789).alias("p_model"), F.lit(0.5).alias("epss"), F.lit(False).alias("kev"),
        F.lit(True).alias("poc_github"), F.lit(False).alias("poc_exploitdb"), F.lit(3.65).alias("cvss_impact"), F.lit(True).alias("scope_changed"), F.lit(float("nan")).alias("cvss_base"),
    )
    backtest.write_shards(intel, f"file://{tmp_path}/s", files=2)
    shards = backtest.read_shards(spark, f"file://{tmp_path}/s")
    findings = spark.createDataFrame([("CVE-2016-1001",), ("CVE-2016-1009",), ("CVE-2016-9",), ("CVE-1999-1",), ("GHSA-x",), ("CVE-201",)], "cve_id string")
    found = backtest.lookup(shards, findings)
    got = {r["cve_id"]: r["p_model"] for r in found.collect()}
    assert got == {"CVE-2016-1001": 0.12346, "CVE-2016-1009": 0.12346, "CVE-2016-9": None, "CVE-1999-1": None, "GHSA-x": None, "CVE-201": None}
    r = found.where("p_model is not null").first()
    assert r["cvss_base"] is None and r["cvss_impact"] == round(3.65, 1) and r["poc_github"] and not r["poc_exploitdb"]
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    found.collect()

    def files(node):
        own = [node.metrics().get("numFiles").get().value()] if node.nodeName().startswith("Scan parquet") else []
        kids = node.children()
        below = [x for i in range(kids.size()) for x in files(kids.apply(i))]
        inner = files(node.executedPlan()) if node.nodeName() == "AdaptiveSparkPlan" else files(node.plan()) if "QueryStage" in node.nodeName() else []
        return own + below + inner

    plan.executeCollect()
    there = {y.name: len(list(y.glob("*.parquet"))) for y in (tmp_path / "s").iterdir() if y.is_dir()}
    assert files(plan) == [there["id_year=2016"]] and sum(there.values()) >= 8


def test_a_feature_that_tells_nothing_has_no_importance(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.normal(size=400), rng.normal(size=400)], 1)
    y = (x[:, 0] > 0.7).astype(int)
    step = boosting.Tree(*(np.array(a) for a in ([0, -1, -1], [0, 0, 0], [0.7, 0, 0], [1, -1, -1], [2, -1, -1], [0.0, -1.0, 1.0], [400.0, 300.0, 100.0], [1.0, 0, 0])))
    model = boosting.Ensemble(0.0, [step], 1, [], 2)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "key long, x array<double>, y int").repartition(3)
    pairs = importance.shuffled(spark, df, "key", "x", 1).select("x", "other").collect()
    assert sorted(r["other"] for r in pairs) == sorted(r["x"] for r in pairs) and sum(r["x"] == r["other"] for r in pairs) < 20
    got = {r["feature"]: r["importance"] for r in importance.permutation_importance(spark, df, model, ["a", "b"]).collect()}
    assert abs(got["b"]) < 1e-12 and 0.3 < got["a"] < 0.9


def test_a_state_is_published_whole_or_not(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    assert sinks.manifest(spark, folder) is None
    with pytest.raises(ValueError):
        sinks.published(spark, folder, "t")
    one = sinks.publish(spark, folder, {"t": spark.range(3), "u": spark.range(2)}, {"at": dt.date(2024, 1, 2), "auc": float("nan"), "top": [np.float64(0.5), np.int64(3)]}, release="one")
    assert one == sinks.manifest(spark, folder) and (one["at"], one["auc"], one["top"]) == ("2024-01-02", None, [0.5, 3]) and one["tables"]["t"] == {"rows": 3, "columns": ["id"]}
    with pytest.raises(Exception):  # noqa: B017  a run that dies in its second table
        sinks.publish(spark, folder, {"t": spark.range(9), "u": spark.range(1).select(F.raise_error(F.lit("dies")))}, release="two")
    assert sinks.published(spark, folder, "t").count() == 3 and sinks.manifest(spark, folder)["release"] == "one"
    sinks.publish(spark, folder, {"t": spark.range(5)}, release="three")
    assert sinks.published(spark, folder, "t").count() == 5
    with pytest.raises(OSError):
        sinks.publish(spark, folder, {"t": spark.range(1)}, release="three")
    day = spark.createDataFrame([("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 2, 3, 4, 5)), ("c", None)], "cve string, kev_date_added timestamp")
    assert sorted(map(tuple, sinks.exploited_snapshot(day).collect())) == [("a", "2024-01-02"), ("b", "2024-01-02T03:04:05")]
