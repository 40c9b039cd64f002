"""Phrases, alignment and sharding against brute force."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import fixtures as X
from triagegrid.llm import alignment, phrases, queries, sharding

BPE = public_tokenizers.path("byte_bpe_50k.json")
SP = public_tokenizers.path("piece_bpe_32k.model")
FEW = "ka to mi ren".split()


def wordy(seed=3):
    """Few words, so that phrases of any length repeat; languages, nulls, odd characters, copies and one long text."""
    rng = np.random.default_rng(seed)
    say = lambda n: "".join(rng.choice(FEW) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "? "], p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]) for _ in range(n))
    texts = [None, "", " \t", ".,;", "A b\x0bc", "É é x   y"] + [say(int(rng.integers(1, 60))).title() for _ in range(60)] + [say(4000)] + ["gnu public licence here. gnu public licence"] * 9
    return [(i % 70, t, [None, "en", "de", ""][i % 4] if i > 6 else "en", "s", None) for i, t in enumerate(texts)]


def brute_phrases(rows, least, limit, longest=3, inside=50):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang if lang is not None else "und"] += len(ws)
            for k in range(1, longest + 1):
                f[lang if lang is not None else "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if any(100 * b >= inside * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, cut = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), count[p[:cut]], count[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest, least, limit, chunk, buckets", [(3, 10, 2000, 1 << 20, 3), (3, 2, 7, 300, 5), (4, 3, 2000, 64, 2)])
def test_phrases_against_brute_force(spark, longest, least, limit, chunk, buckets):
    rows = wordy()
    got = phrases.collocations(spark, X.frame(spark, rows), longest, least, limit=limit, chunk=chunk, buckets=buckets)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, limit, longest)


def test_phrases_query_and_its_sql(spark, tmp_path):
    X.frame(spark, wordy()).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_phrases(spark, f"file://{tmp_path}").toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(queries.ORACLE["op11_phrases"]).df()[list(got.columns)]
    by = ["lang", "rank"]
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True))
    assert len(got) > 10
    assert phrases.collocations(spark, X.frame(spark, [])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, one, two = 3_000_000_019, 3_000_000_021, 7_000_000_001
    rows = [("en", 1, "x", one), ("en", 1, "y", two), ("en", 2, "x y", a)]
    known = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    got = phrases.scored(known.where("k = 2"), known).first()
    assert got["score"] == 10**6 * a * a // (one * two) and (got["l"], got["r"]) == (one, two)


def test_numbers_come_back_from_their_planes():
    rng = np.random.default_rng(1)
    for top in (1, 2, 300, 1 << 40, 1 << 63):
        v = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        assert (phrases.unpacked(phrases.packed(v)) == v).all() and (phrases.unplaned(phrases.planes(v)) == v).all()
    assert len(phrases.unplaned(phrases.planes(np.zeros(0, np.uint64)))) == 0


def brute_alignment(rows):
    tok, sp = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=SP)
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    docs, holds = [], collections.Counter()
    for _, text, *_ in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            own_a = [bytes(byte[c] for c in tok.id_to_token(i)) for i in a]
            own_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
            if b"".join(own_a) == b"".join(own_b) == b" " + text.encode():
                i = j = ea = eb = 0
                group = [[], []]
                while i < len(a):
                    links.append((a[i], b[j]))
                    na, nb = ea + len(own_a[i]), eb + len(own_b[j])
                    if na <= nb:
                        group[0].append(a[i])
                        i, ea = i + 1, na
                    if nb <= na:
                        group[1].append(b[j])
                        j, eb = j + 1, nb
                    if ea == eb:
                        groups.append(group)
                        group = [[], []]
            else:
                a, b = [], []
        holds.update(set(links))
        docs.append((a, b, groups, links))
    best = collections.Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for (i, *_), (a, b, groups, links) in zip(rows, docs):
        said = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(holds[k] == best[k[0]] for k in links), sum(holds[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out)


def odd_texts():
    odd = ["<|endoftext|> <s> </s> <unk>", "a▁b", "日本語 😀 \x00", "  two  spaces ", "q" * 700, "\n\n\t\r\n", "é" * 50, "don't x’s …", "ﬁ Å"]
    return X.documents(copies=6)[:20] + [(i % 4, t, None, None, None) for i, t in enumerate(odd + odd[:3])]


def test_alignment_query_against_brute_force(spark, tmp_path, monkeypatch):
    rows = odd_texts()
    monkeypatch.setattr(alignment, "HELD", 500)
    X.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_alignment(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == brute_alignment(rows)
    assert any(r[1] == 0 and t for r, (_, t, *_) in zip(brute_alignment([("x", "a▁b")]), [(0, "a▁b")]))
    assert alignment.alignment(spark, X.frame(spark, []), BPE, SP).count() == 0


def test_shards_are_sorted_and_split_anywhere(spark):
    made = alignment.encode(spark, X.frame(spark, odd_texts()), BPE, SP).select("pairs").collect()
    want = collections.Counter(int(k) for r in made if r["pairs"] for k in phrases.unpacked(r["pairs"]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = alignment.pair_counts(spark, spark.createDataFrame(made, "pairs binary"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = np.array(sorted(want), np.uint64)
    assert alignment.look_up(counts, keys).tolist() == [want[int(k)] for k in keys]
    assert alignment.look_up(counts, keys + np.uint64(1)).sum() == sum(want.get(int(k) + 1, 0) for k in keys)
    assert sum(len(alignment.mapped(f"{p}.keys", np.uint64)) for p in counts.paths) == len(want) and len(counts.paths) > 1


def shards_hold(rows, got):
    """What the law says of any result, and how many equal pairs are together, of how many."""
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    n = [len(slots[s]) for s in range(8)]
    assert sum(n) == len(got) and max(n) - min(n) <= 1 and set(slots) <= set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    pairs = lambda c: sum(k * (k - 1) // 2 for k in c.values())
    return pairs(collections.Counter((r["size"], r["text_crc32"], r["shard"]) for r in got)), pairs(collections.Counter((r["size"], r["text_crc32"]) for r in got))


def test_sharding_query_keeps_its_law_and_its_groups(spark, tmp_path):
    rows = [(i % 300, t, None, None, None) for i, t in enumerate([None, "", None, "é", "é"] + [f"group {i // 4}" for i in range(160)] + [f"own {i}" for i in range(240)])]
    X.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept, every = shards_hold(rows, queries.op13_sharding(spark, f"file://{tmp_path}").collect())
    assert kept >= 0.98 * every > 0
    assert sharding.shard_documents(spark, X.frame(spark, [])).count() == 0
    shards_hold(rows[:5], sharding.shard_documents(spark, X.frame(spark, rows[:5])).collect())


def test_a_group_larger_than_a_shard_takes_few_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"own {i % 500}", None, None, None) for i in range(1200)]
    got = sharding.shard_documents(spark, X.frame(spark, rows)).collect()
    kept, every = shards_hold(rows, got)
    hot = collections.Counter(r["shard"] for r in got if r["size"] == 4)
    # 400 of 1,200 rows, 150 to a shard, beside 300 pairs that stay where they are: at random the eight shards would keep an eighth.
    assert kept > 0.18 * every and max(hot.values()) > 100


def test_hot_hubs_are_salted_and_give_the_same_labels_a_majority(spark):
    links = spark.createDataFrame([(i, "a") for i in range(90)] + [(100 + i, "b") for i in range(10)] + [(100, "a")], "row long, hub string")
    cut, hot = sharding.salted(links, 101, share=10, least=5)
    assert {r["hub"]: r["salts"] for r in hot.collect()} == {"a": 9} and cut.groupBy("hub", "salt").count().where("count > 40").isEmpty()
    labels = {r["row"]: r["label"] for r in sharding.propagate(spark, links, 400, shards=4, share=10, least=5).collect()}
    assert len(labels) == 100 and len({labels[i] for i in range(90)}) == 1


def test_quotas_never_overfill_and_let_shards_exchange():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sizes = rng.integers(50, 150, 6).astype(float)
        wish = rng.integers(0, 8, (6, 6, 4)).astype(float)
        part = sharding.quotas(wish, sizes, 110.0)
        moved = wish * part
        after = sizes + moved.sum((0, 2)) - moved.sum((1, 2))
        assert (part >= 0).all() and (part <= 1).all() and ((after <= 110 + 1e-6) | (after <= sizes + 1e-6)).all()
    swap = np.zeros((2, 2, 1))
    swap[0, 1], swap[1, 0] = 5, 5
    assert (sharding.quotas(swap, np.array([10.0, 10.0]), 10.0)[swap > 0] == 1).all()
