import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyarrow import fs

from tests.llm import fixtures as X
from triagegrid.llm import covertree, urls, warc

PAGES = "page_id long, url string, html string"


def test_reader_finds_every_record_whatever_the_splits(tmp_path):
    rng = random.Random(1)
    recs, blob = [], b""
    for i in range(150):
        p = rng.randbytes(rng.choice([0, 5, 100, 3000, 50000])) if i % 3 else warc.MAGIC * rng.randint(0, 500)
        pack = zlib.compressobj(3, zlib.DEFLATED, 31)
        blob += pack.compress(warc.record(i, "http://x/\n" + str(i), p, "d", None)) + pack.flush()
        recs.append((i, p))
    (tmp_path / "x.warc.gz").write_bytes(blob)
    store = fs.LocalFileSystem()
    for split in (999, 65536, 10**9):
        out = []
        for s in range(0, len(blob), split):
            out += [(int(r["x-page-id"]), r["payload"]) for r in warc.records_in(store, f"{tmp_path}/x.warc.gz", s, min(s + split, len(blob)), len(blob))]
        assert out == recs


def test_archive_round_trip(spark):
    long = "<p>é" + "x" * 2000
    rows = [(1, "http://a", long), (9, "http://b", long), (4, None, long), (5, "http://c", "short"), (6, "http://d", "short"), (7, "u", None), (7, "u", None), (None, "n", long), (8, "http://e", long + "!")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS d", "2 AS payload", "'x' AS top")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(spark, df, split=300).collect()), key=str)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        top = 9 if h == long and i is not None and i != 9 else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if top else "response", top))
    assert got == sorted(want, key=str)
    assert warc.archive(spark, df.limit(0)).count() == 0


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    rows = [
        "https://www.Example.com/en/1?x#y", "http://example.com/en/", "http://a.com", "http://xexample.com/en/", "ftp://shop.net/es/z", "http://net/fr/", "no scheme", None, "", "a://b://c/d",
        "http://spam.net/fr/1", "http://HOST.org?q=/en/", "http://x.com/\n/en/", "http://cheap-pills.example.org/en/3",
    ]
    df = spark.createDataFrame([(i, u, "<title>cheap pills</title>") for i, u in enumerate(rows)], PAGES).selectExpr("*", "1 AS host", "2 AS label")
    out = {r["page_id"]: r for r in urls.score_urls(spark, df).collect()}
    for i, u in enumerate(rows):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]
        want, verdict = rule(host, path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, want)
        assert out[i]["verdict"] == verdict or verdict is None and out[i]["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in urls.score_urls(spark, df.where("page_id in (6, 7)")).collect()} == {"allow"}
    assert urls.score_urls(spark, df.limit(0)).count() == 0


def test_segmentation_is_the_best_of_all_splits():
    s = urls.Segmenter({w: float(np.log(n / 100)) for w, n in (("cheap", 9), ("pills", 8), ("pill", 5), ("s", 3), ("spam", 9), ("farm", 9))}, 100.0)
    assert s.split("cheappills") == ["cheap", "pills"] and s.split("spamfarms") == ["spam", "farm", "s"] and s.split("") == []

    def all_splits(x):
        if not x:
            yield []
        for i in range(1, len(x) + 1):
            for rest in all_splits(x[i:]):
                yield [x[:i], *rest]

    cost = lambda ws: sum(s.words.get(w, -np.log(s.total) - len(w) * np.log(10)) for w in ws)
    for word in ("pillspam", "xfarmq", "cheapspil"):
        assert cost(s.split(word)) == pytest.approx(max(map(cost, all_splits(word))))


def test_cover_tree_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    v = np.concatenate([c + rng.normal(scale=s, size=(25, 8)) for c, s in zip(centres, np.linspace(0.02, 0.6, 12))]).astype(np.float32)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(400 + i, v[3].tolist(), 0) for i in range(6)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] + [1.0] * 7, 1), (504, [None] + [1.0] * 7, 1), (505, [float("inf")] + [1.0] * 7, 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1), (508, (v[3] * 2).tolist(), 1)]
    monkeypatch.setattr(covertree, "BLOCK", 60)
    df = spark.createDataFrame(rows + [(None, v[3].tolist(), 0)], "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS rep", "2 AS node", "3 AS v")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in covertree.links(spark, df).collect()}
    good = {i: np.array(x, float) for i, x, _ in rows if x and None not in x and np.isfinite(x).all() and np.any(x)}
    ids = [i for i, *_ in rows]
    link = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95]
    comp, n = X.components(ids, link), {i: 0 for i in ids}
    for a, b in link:
        n[a] += 1
        n[b] += 1
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in ids} | {None: (0, None, True)}
    assert covertree.links(spark, df.limit(0)).count() == 0
