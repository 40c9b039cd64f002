import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm import fixtures as X
from triagegrid.llm import linededup, ngramjoin, queries, setjoin, wordhash
from triagegrid.llm.common import connected_components


def test_words_are_ascii_words_wherever_texts_are_cut():
    texts = ["", None, " a  B\x0bc ", "ÀÉ x", "tail", "head\n\nnext", "\u00a0no break\u2003space"]
    for size in (1, 5, 1000):
        got = []
        for first, t in wordhash.slices(pa.array(texts), size):
            w = wordhash.words(t)
            got += list(zip((w.row + first).tolist(), w.hash.tolist()))
        want = [(i, x) for i, t in enumerate(texts) for x in (t or "").encode().lower().split()]
        assert [r for r, _ in got] == [r for r, _ in want]
        by = {}
        for (_, h), (_, x) in zip(got, want):
            assert by.setdefault(x, h) == h
        assert len(set(by.values())) == len(by)


def test_prefix_keys_never_miss_a_similar_pair():
    """Any two similar sets share a key, whatever the token counts and set sizes."""
    rng = random.Random(4)
    rank = np.array([rng.choice([0, 1, 5, 40, 90, 200]) for _ in range(1 << 8)], np.uint8)
    rarity = setjoin.Rarity(rank, 3.0)
    for subsets in (setjoin.Subsets(((12, 2),), (-np.inf, np.inf)), setjoin.Subsets(((8, 3), (30, 2)), (2.0, 40.0)), setjoin.Subsets((), (5.0, 9.0))):
        for _ in range(400):
            n = rng.randint(1, 60)
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, n // 4)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 5))}
            k = len(a & b)
            if 4 * k < 3 * len(a | b) or a == b:
                continue
            keys = []
            for s in (a, b):
                off, key = setjoin.grouped(np.zeros(len(s), np.int64), rarity.keys(np.array(sorted(s), np.uint64)), 1)
                keys.append({int(x) for x in setjoin.prefix_keys(off, key, subsets, rarity.load, False)[1]})
            assert keys[0] & keys[1]


def test_ngram_join_against_all_pairs(spark):
    rows = X.documents()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(spark, X.frame(spark)).collect()}
    sets = {r[0]: X.shingles(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if X.similar(sets[a], sets[b])]
    want = X.components(ids, links)
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    assert len({want[i] for i in range(11, 35)}) < 24  # the edited copies hang together


def test_ngram_join_of_a_large_group_of_edited_copies(spark):
    rows = [(i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(r for r in X.documents(seed=8, copies=150))]
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_duplicates(spark, X.frame(spark, rows)).collect()}
    sets = {r[0]: X.shingles(r[1]) for r in rows}
    ids = sorted(sets)
    assert got == X.components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if X.similar(sets[a], sets[b])])


def test_members_of_dealt_lists_meet_once_each(spark):
    rows = [(k, i, 0) for k, n in ((1, 1), (2, 7), (3, 40)) for i in range(n)]
    left, right = ngramjoin.dealt(spark.createDataFrame(rows, "key long, a_hi long, a_lo int"), size=5)
    got = sorted((r[0], r[1]) for r in left.join(right.withColumnRenamed("a_hi", "b_hi"), "key").select("a_hi", "b_hi").collect())
    assert got == sorted((i, j) for n in (1, 7, 40) for i in range(n) for j in range(n))


def test_ngram_join_without_rounds_of_heads(spark, monkeypatch):
    """What is left meets in full, in small parts."""
    monkeypatch.setattr(ngramjoin, "ROUNDS", 0)
    whole = ngramjoin.dealt
    monkeypatch.setattr(ngramjoin, "dealt", lambda lists: whole(lists, size=3))
    rows = X.documents(seed=6)
    sets = {i: X.shingles(t) for i, t, *_ in rows}
    want = X.components(list(sets), [(a, b) for a in sets for b in sets if a < b and X.similar(sets[a], sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.near_duplicates(spark, X.frame(spark, rows)).collect()}
    assert got == want


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g"
    rows = [(None, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (3, text, "en", "s", 1), (None, None, None, None, None)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(spark, X.frame(spark, rows)).collect()), key=str)
    assert got == [(3, 3, 3), (5, 3, 3), (5, 3, 3), (None, 0, None), (None, 3, None)]
    assert [(r["hi"], r["los"]) for r in linededup.repeated_lines(spark, X.frame(spark, rows)).collect()] == [(5, [0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_against_all_pairs(spark, seed):
    rows = X.documents(seed=seed, copies=80)
    got = {r["hi"]: r["los"] for r in linededup.repeated_lines(spark, X.frame(spark, rows)).collect()}
    assert got == X.later_lines(rows)


def test_second_look_tells_members_not_pairs(spark, monkeypatch):
    """Lines that bitmaps cannot tell apart: all are open after the first look, few are similar to an earlier one."""
    rng = random.Random(9)
    base = [X.sentence(rng, 1) + str(i) for i in range(60)]
    lines = []
    for i in range(160):
        own = [f"own{i}x{k}" for k in range(8)]
        lines.append(" ".join(base[k] if k not in out else own.pop() for out in [set(rng.sample(range(60), 8))] for k in range(60)))
    lines += [" ".join(lines[k].split()[:57] + [f"late{k}a", f"late{k}b", f"late{k}c"]) for k in (70, 90, 110)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(lines)]
    whole, told = setjoin.materialize, {}

    def counted(spark, df, tag):
        out = whole(spark, df, tag)
        told.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(setjoin, "materialize", counted)
    monkeypatch.setattr(setjoin, "OPEN_BYTES", 30_000)
    got = {r["hi"]: r["los"] for r in linededup.repeated_lines(spark, X.frame(spark, rows)).collect()}
    assert got == X.later_lines(rows) and 160 in got
    assert told["join-open"][0] > 80
    assert max(n for tag, counts in told.items() if tag.startswith("join-open") for n in counts) <= 8 * len(rows)


def test_dropping_lines_keeps_the_rest(spark):
    rows = [(1, "a b c\n\nd e f\n", "en", "s", 0), (2, "x\nd e f\ng h i", "en", "s", 0), (3, None, "en", "s", 0)]
    df = X.frame(spark, rows)
    out = linededup.drop_lines(df, linededup.repeated_lines(spark, df))
    assert {(r["doc_id"], r["text"], r["dropped"]) for r in out.collect()} == {(1, "a b c\n\nd e f\n", 0), (2, "x\ng h i", 1), (3, None, 0)}


def test_lines_of_one_and_two_words_go_with_least_1(spark, tmp_path):
    texts = ["Read more\nq\nalpha beta gamma", "more read\n\n}\nRead", "READ\n}\nread more more\nalpha beta"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    X.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in queries.op5_line_dedup(spark, f"file://{tmp_path}").collect()}
    assert got == {0: "", 1: "0", 2: "0,1,2"}


def test_a_repeated_id_keeps_a_copy_of_every_line(spark, tmp_path):
    """Nothing stands before the repeated id: equal texts keep their lines, of different ones only later copies go."""
    equal = X.frame(spark, [(5, "a b c d", "en", "s", 7), (5, "a b c d", "en", "s", 7), (9, "p q r s\na b c d", "en", "s", 15)])
    gone = linededup.repeated_lines(spark, equal)
    assert [(r["hi"], r["los"]) for r in gone.collect()] == [(9, [1])]
    left = corpus_pipeline.remove_repeated_lines(spark, equal, "")
    assert sorted(r["text"] for r in left.collect()) == ["a b c d", "a b c d", "p q r s"]
    assert sorted(r["text"] for r in corpus_pipeline.keep_one_of_each_class(spark, left, "").collect()) == ["a b c d", "p q r s"]
    texts = ["k l m n\nshared line stands here", "w x y z\nshared line stands here", "e f g h\nnothing like it elsewhere"]
    other = X.frame(spark, [(5, t, "en", "s", 1) for t in texts])
    left = [r["text"] for r in corpus_pipeline.remove_repeated_lines(spark, other, "").collect()]
    lines = sorted(x for t in left for x in t.split("\n"))
    assert lines == sorted({x for t in texts for x in t.split("\n")}) and texts[2] in left
    other.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["removed"] for r in queries.op5_line_dedup(spark, f"file://{tmp_path}").collect()) == ["", "", "1"]
    assert corpus_pipeline.keep_one_of_each_class(spark, other, "").count() == 3


def test_empty_tables(spark):
    none = X.frame(spark, [])
    assert ngramjoin.near_duplicates(spark, none).count() == 0
    assert linededup.repeated_lines(spark, none).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == X.components(nodes, [e for e in edges if e[0] != e[1]])
