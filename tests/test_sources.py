import gzip
import json
import lzma

import pytest

from triagegrid.plans.application import score_application
from triagegrid.sources import feeds, scans
from triagegrid.sources.assets import read_services

VECTOR = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"


def item(cve, **more):
    return {
        "id": cve, "published": "2023-05-06T10:00:00.000", "vulnStatus": "Analyzed", "cisaExploitAdd": "2024-01-01",
        "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "Remote code execution"}],
        "metrics": {"cvssMetricV31": [{"type": "Secondary", "cvssData": {"vectorString": "CVSS:3.1/bad", "baseScore": 1.0}}, {"type": "Primary", "cvssData": {"vectorString": VECTOR, "baseScore": 9.8}}]},
        "weaknesses": [{"type": "Secondary", "description": [{"lang": "en", "value": "CWE-1"}]}, {"type": "Primary", "description": [{"lang": "en", "value": "NVD-CWE-noinfo"}, {"lang": "en", "value": "CWE-79"}]}],
        "references": [{"url": "https://X.exploit-db.com/1", "tags": ["Exploit"]}, {"url": "https://x.exploit-db.com/1", "tags": ["Patch"]}, {"url": "https://www.cisa.gov/kev?x", "tags": ["Exploit"]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"vulnerable": False, "criteria": "cpe:2.3:a:no:no:1"}, {"vulnerable": True, "criteria": "cpe:2.3:a:Acme:Tool:1"}]}]}],
    } | more


def test_records(spark, tmp_path):
    rejected = item("CVE-2023-3", vulnStatus="Rejected")
    (tmp_path / "a-2022.json.xz").write_bytes(lzma.compress(json.dumps({"cve_items": [item("CVE-2023-1", descriptions=[]), rejected]}).encode()))
    (tmp_path / "b-2023.json.gz").write_bytes(gzip.compress(json.dumps({"vulnerabilities": [{"cve": item("CVE-2023-1")}]}).encode()))
    (tmp_path / "c.json").write_text(json.dumps([item("CVE-2023-2", published="never"), item("CVE-2023-4", metrics={}, configurations=[], weaknesses=[], references=[])]))
    rows = {r["cve"]: r for r in feeds.read_records(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"CVE-2023-1", "CVE-2023-4"}
    r = rows["CVE-2023-1"]  # the later file's
    assert (r["description"], r["cvss_base"], r["cvss_impact"], r["cwe"], r["vendor"], r["product"]) == ("Remote code execution", 9.8, 5.9, "CWE-79", "acme", "acme:tool")
    assert (r["ref_total"], r["ref_exploit"], r["ref_patch"], r["dom_exploitdb"], r["dom_github"]) == (1, 1, 1, 1, 0)
    assert rows["CVE-2023-4"]["cvss_vector"] is None and rows["CVE-2023-4"]["cwe"] == "noinfo"
    assert not any("cisa" in c.lower() for c in feeds.read_records(spark, f"file://{tmp_path}").columns)


def test_small_feeds(spark, tmp_path):
    (tmp_path / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": " CVE-1 ", "dateAdded": "2024-02-01"}, {"cveID": "CVE-1", "dateAdded": "2023-01-05"}, {"cveID": "CVE-2", "dateAdded": "soon"}]}))
    kev = {r["cve"]: str(r["kev_date_added"])[:10] for r in feeds.read_exploited(spark, f"file://{tmp_path}/kev.json").collect()}
    assert kev == {"CVE-1": "2023-01-05", "CVE-2": "None"}
    assert feeds.exploited_catalogue(spark, f"file://{tmp_path}/kev.json") == {"catalogVersion": None, "dateReleased": None, "count": 3}
    with gzip.open(tmp_path / "epss.csv.gz", "wt") as f:
        f.write("#model_version:v1,score_date:2024-01-01T00:00:00\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-1,0.1,0.1\nCVE-2,x,0.2\n")
    scores, meta = feeds.read_scores(spark, f"file://{tmp_path}/epss.csv.gz")
    assert meta == {"model_version": "v1", "score_date": "2024-01-01T00:00:00"} and {tuple(r) for r in scores.collect()} == {("CVE-1", 0.5, 0.9), ("CVE-2", 0.0, 0.2)}
    (tmp_path / "2023").mkdir()
    (tmp_path / "2023/CVE-7.json").write_text(json.dumps([{"created_at": "2023-05-05T10:00:00Z"}, {"created_at": "2023-05-04T10:00:00Z"}]))
    (tmp_path / "2023/CVE-8.json").write_text("{broken")
    assert [(r["cve"], str(r["first_ts"])) for r in feeds.read_poc_repositories(spark, f"file://{tmp_path}/2023").collect()] == [("CVE-7", "2023-05-04 10:00:00")]
    (tmp_path / "x.csv").write_text('id,codes,date_published,date_added\n1,"CVE-2020-1234;OSVDB-1;CVE-2020-99999",,2020-02-02\n2,CVE-2020-1234,2020-01-01,2021-01-01\n')
    assert {(r["cve"], str(r["first_ts"])[:10]) for r in feeds.read_exploit_archive(spark, f"file://{tmp_path}/x.csv").collect()} == {("CVE-2020-1234", "2020-01-01"), ("CVE-2020-99999", "2020-02-02")}


BOM = {
    "metadata": {"component": {"bom-ref": "root", "name": "Shop"}},
    "components": [
        {"bom-ref": "r1", "group": "org", "name": "core", "version": "1", "purl": "pkg:maven/org/core@1", "components": [{"name": "inner", "version": "2", "properties": [{"name": "dependency:depth", "value": "x"}, {"name": "dependency:type", "value": "transitive"}]}]},
        {"name": "noversion"},
        {"bom-ref": "r3", "name": "Web", "version": "3"},
    ],
    "dependencies": [{"ref": "root", "dependsOn": ["r3"]}, {"ref": "r3", "dependsOn": ["r1"]}, {"ref": "r1", "dependsOn": ["inner@2"]}],
}


def write(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return f"file://{path}"


def test_bill_of_materials(spark, tmp_path):
    comps, deps, root = scans.read_bom(spark, write(tmp_path / "b.json", BOM))
    got = [(r["ord"], r["bom_ref"], r["group"], r["dependency_depth"], r["dependency_type"]) for r in comps.orderBy("ord").collect()]
    assert got == [(0, "r1", "org", 0, "direct"), (1, "inner@2", "", 0, "transitive"), (2, "r3", "", 0, "direct")]
    assert root == ("root", "Shop") and deps.count() == 3
    with pytest.raises(ValueError):
        scans.read_bom(spark, write(tmp_path / "n.json", {"metadata": {}}))


def test_scans(spark, tmp_path):
    csv = 'component,version,cve_id,cvss_base,cvss_vector,description,host,cvss_scope\n"a, b",1,CVE-1,9.8,,"says ""hi""",h,CHANGED\nx,1,,5,,,,\n'
    kind, rows = scans.read_scan(spark, write(tmp_path / "s.csv", csv))
    r = rows.collect()
    assert kind == "csv" and len(r) == 1 and (r[0]["pkg_name"], r[0]["description"], r[0]["scope_changed"], r[0]["cvss_impact"]) == ("a, b", 'says "hi"', True, 5.88)
    with pytest.raises(ValueError, match="version, cve_id"):
        scans.read_scan(spark, write(tmp_path / "t.csv", "component,cvss_base\n"))
    xml = """<R><ReportHost name="pay"><ReportItem pluginName="p"><cve>CVE-1</cve><cve>CVE-2</cve><cpe>cpe:/a:v:openssl:1.0</cpe><cvss_base_score>5.0</cvss_base_score></ReportItem>
        <ReportItem pluginName="q"><cve>CVE-3</cve></ReportItem><ReportItem pluginName="none"/></ReportHost></R>"""
    rows, skipped = scans.read_nessus(spark, write(tmp_path / "s.nessus", xml))
    assert {(r["cve_id"], r["pkg_name"], r["pkg_version"], r["host"], r["cvss_base"], r["description"]) for r in rows.collect()} == {("CVE-1", "openssl", "1.0", "pay", 5.0, "p"), ("CVE-2", "openssl", "1.0", "pay", 5.0, "p")}
    assert skipped.first()["n"] == 1
    with pytest.raises(ValueError):
        scans.read_scan(spark, write(tmp_path / "u.json", {"x": 1}))


def test_services_in_both_forms(spark, tmp_path):
    a = read_services(spark, write(tmp_path / "a.json", {"services": {"Pay": {"tier": 1, "components": ["Core@1"]}, "Old": {"criticality": "Low"}}})).collect()
    assert {(r["name"], r["tier"], r["criticality"], tuple(r["components"])) for r in a} == {("Pay", 1, "Critical", ("core@1",)), ("Old", 3, "Low", ())}
    b = read_services(spark, write(tmp_path / "b.json", {"services": [{"name": "x", "criticality": "High", "internet_facing": True}, {"tier": 1}]})).collect()
    assert [(r["name"], r["tier"], r["internet_facing"]) for r in b] == [("x", 2, True)]
    for bad in ({"services": 3}, {"services": {"x": {"tier": 9}}}):
        with pytest.raises(ValueError):
            read_services(spark, write(tmp_path / "c.json", bad))


def test_application_end_to_end(spark, tmp_path):
    trivy = {"Results": [{"Vulnerabilities": [
        {"VulnerabilityID": "CVE-1", "PkgName": "zzz", "InstalledVersion": "9", "PkgIdentifier": {"PURL": "pkg:maven/ORG/core@1?type=jar"}, "CVSS": {"redhat": {"V3Score": 7.5, "V3Vector": VECTOR}, "nvd": {"V3Score": 0}}},
        {"VulnerabilityID": "CVE-1", "PkgName": "org:core", "InstalledVersion": "1"},
        {"VulnerabilityID": "CVE-2", "PkgName": "web", "InstalledVersion": "3"},
        {"VulnerabilityID": "CVE-3", "PkgName": "webby", "InstalledVersion": "3"},
        {"VulnerabilityID": "CVE-4", "PkgName": "gone", "InstalledVersion": "3"}]}]}
    intel = spark.createDataFrame([("CVE-1", 0.9, 0.8, True, True, False, 5.9, False, 9.8), ("CVE-2", None, 0.1, False, False, False, 3.6, True, 5.0)], "cve string, p_model double, epss double, kev boolean, poc_github boolean, poc_exploitdb boolean, cvss_impact double, scope_changed boolean, cvss_base double")
    args = (spark, write(tmp_path / "b.json", BOM), write(tmp_path / "s.json", trivy), intel, 0.01)
    rows = score_application(*args, context=write(tmp_path / "c.json", {"services": {"shop": {"tier": 1, "internet_facing": True}, "other": {"tier": 3}, "w": {"tier": 2, "components": ["web@3"]}}}), fuzzy=True).collect()
    got = [(r["cve_id"], r["component_ref"], r["match"], r["ml"]["rank"], r["fanin"], r["p_source"], [s["name"] for s in r["services"]]) for r in rows]
    assert got == [("CVE-1", "r1", "purl", 1, 2, "model", ["shop"]), ("CVE-2", "r3", "name@version", 2, 1, "prior", ["shop", "w"]), ("CVE-3", "r3", "fuzzy", 3, 1, "prior", ["shop", "w"])]
    assert rows[0]["ml"]["crit_mult"] == pytest.approx(1.8) and rows[1]["vector_source"] == "nvd" and rows[1]["cvss_base"] == 5.0
    assert len(score_application(*args).collect()) == 2
