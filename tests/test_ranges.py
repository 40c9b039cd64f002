import gzip
import json
import lzma
import random

import numpy as np
import pytest

from triagegrid.sources import feeds, ranges

from .test_sources import item


def odd(rng, i):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "é", "😀", "x", " ", "\n", ","]) for _ in range(rng.randint(0, 40)))
    return item(f"CVE-2023-{1000 + i}", descriptions=[{"lang": "en", "value": text}], more={"a": [{"b": [text, {}]}], "\\": {"}": []}})


def documents(n=40):
    rng = random.Random(8)
    items = [odd(rng, i) for i in range(n)]
    return items, {
        "old.json": json.dumps({"note\"[{": [{"no": "record"}], "cve_items": items[:10], "end": [[{"deep": 1}]]}),
        "new.json": json.dumps({"vulnerabilities": [{"cve": x} for x in items[10:20]]}, ensure_ascii=False, indent=1),
        "older.json": json.dumps({"CVE_Items": [x if i % 2 else {"cve": x} for i, x in enumerate(items[20:30])]}),
        "bare.json": "\n " + json.dumps(items[30:], ensure_ascii=False),
        "empty.json": json.dumps({"vulnerabilities": []}),
    }


@pytest.mark.parametrize("split", [37, 1001, 1 << 20])
def test_any_split_gives_the_same_records(spark, tmp_path, split):
    items, docs = documents(20 if split < 1000 else 40)
    for name, text in docs.items():
        (tmp_path / name).write_text(text, "utf-8")
    rows = ranges.read_records(spark, f"file://{tmp_path}", split).collect()
    got = {}
    for r in rows:
        x = json.loads(r["body"])
        x = x.get("cve", x) if "id" not in x else x
        if "id" in x:
            raw = (tmp_path / r["path"].rsplit("/", 1)[1]).read_bytes()
            assert raw[r["item_ord"] :].startswith(r["body"].encode())
            assert x["id"] not in got
            got[x["id"]] = x
    assert got == {x["id"]: x for x in items}
    flat = {r["cve"]: r["description"] for r in feeds.read_records(spark, f"file://{tmp_path}", split=split).collect()}
    assert flat == {x["id"]: x["descriptions"][0]["value"] for x in items}


def test_packed_documents_come_record_by_record(spark, tmp_path):
    items, docs = documents()
    (tmp_path / "a.json.xz").write_bytes(lzma.compress(docs["old.json"].encode()))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(docs["bare.json"].encode()))
    got = {r["item"]["id"] for r in feeds.records(ranges.read_records(spark, f"file://{tmp_path}", 100)).collect()}
    assert got == {x["id"] for x in items[:10] + items[30:]}


def test_pieces_agree_with_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        text = json.dumps({"".join(rng.choice('"\\{}[]ab') for _ in range(rng.randint(0, 6))): [rng.choice(["\\", '"', "\\\\\"", "x{"]) for _ in range(3)]}).encode()
        data = np.frombuffer(text, np.uint8)
        whole = ranges.piece(data, False, False)
        assert whole.step.sum() == 0 and not whole.ends_inside
        at = rng.randint(0, len(data))
        a = ranges.piece(data[:at], False, False)
        b = ranges.piece(data[at:], a.ends_inside, a.ends_odd)
        assert np.array_equal(np.append(a.step, b.step), whole.step) and b.ends_inside == whole.ends_inside
