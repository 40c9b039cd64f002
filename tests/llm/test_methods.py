"""Cases that each method must get right: structured words, nested members, unigram models, clashing columns, many spans."""

import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm import fixtures as X
from triagegrid.llm import covertree, language, ngramjoin, pieces, secrets, setjoin, urls, warc, wordhash


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


def test_structured_long_words_differ():
    for n in (64, 1024, 2048, 4096):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        _, t = next(wordhash.slices(pa.array([f"{x} {y} {x}"])))
        h = wordhash.words(t).hash
        assert h[0] != h[1] and h[0] == h[2]
        _, t = next(wordhash.slices(pa.array([f"p q {x} r s t", f"p q {y} r s t"])))
        sets = ngramjoin.shingle_sets(t)
        assert len(set(sets.hash.tolist())) == 4  # two shingles each, all different


def gz(raw, level=3):
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def test_reader_passes_over_members_inside_payloads(spark, tmp_path):
    rng = random.Random(3)
    inner = b"".join(gz(warc.record(700 + i, "http://in", rng.randbytes(3000), "d", None)) for i in range(5))
    blob = b""
    for i in range(3):
        payload = rng.randbytes(30000) + inner + rng.randbytes(25000) + inner
        blob += gz(warc.record(i, "http://x", payload, "d", None), 0 if i != 1 else 3)  # level 0 stores the payload as it is
    (tmp_path / "n.warc.gz").write_bytes(blob)
    files = spark.createDataFrame([(f"file://{tmp_path}/n.warc.gz", len(blob))], "path string, size long")
    for split in (5000, 20000, 1 << 24):
        assert sorted(r["page_id"] for r in warc.read_archives(spark, files, split).collect()) == [0, 1, 2]


def toy(rng, unigram=True):
    vocab = {c: (i, -rng.uniform(2, 6)) for i, c in enumerate("abc▁")}
    while len(vocab) < 14:
        vocab.setdefault("".join(rng.choice("abc▁") for _ in range(rng.randint(2, 4))), (len(vocab), -rng.uniform(2, 9)))
    return pieces.Pieces.__new__(pieces.Pieces).fill(list(vocab), vocab, {}, 99, unigram)


def test_unigram_search_takes_the_greatest_sum_of_scores():
    for seed in range(40):
        rng = random.Random(seed)
        model = toy(rng)
        text = "".join(rng.choice("abcz" if seed % 2 else "abc▁") for _ in range(rng.randint(1, 9)))
        weight = lambda ws: sum(model.score.get(w, model.outside if len(w) == 1 else -np.inf) for w in ws)  # noqa: B023, E731
        cuts = itertools.product([0, 1], repeat=len(text) - 1)
        splits = ["".join(c + "\0" * k for c, k in zip(text, [*cut, 0])).split("\0") for cut in cuts]
        found = list(pieces.search(text, model))
        assert "".join(found) == text and abs(weight(found) - max(map(weight, splits))) < 1e-9
    # Long texts are committed piece by piece with the same result as in one window.
    rng = random.Random(5)
    model = toy(rng)
    text = "".join(rng.choice("abc▁z") for _ in range(3000))
    best = [0.0] + [-np.inf] * len(text)
    for i in range(1, len(text) + 1):
        for j in range(max(0, i - 4), i):
            w = text[j:i]
            best[i] = max(best[i], best[j] + model.score.get(w, model.outside if len(w) == 1 else -np.inf))
    assert abs(sum(model.score.get(w, model.outside) for w in pieces.search(text, model)) - best[-1]) < 1e-6


def postings(sets):
    """Postings of one list over the given sets of numbers, all by one key."""
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    m = wordhash.mix(np.array([x for s in sets for x in sorted(s)], np.uint64))
    n = np.diff(off)
    wide = setjoin._width(n, setjoin.Lengths(1.0, 1.0))
    maps = setjoin._bitmaps(m, off, wide)
    k = len(sets)
    return setjoin.Postings(np.zeros(k, np.uint64), np.arange(k), np.zeros(k, np.int32), np.zeros(k, np.int32), n, np.zeros(k, np.uint8), np.arange(k).astype(np.uint64), wide, np.cumsum(wide) - wide, maps)


def test_every_similar_pair_is_a_candidate_or_its_item_is_open(monkeypatch):
    for seed in range(30):
        rng = random.Random(seed)
        base = [rng.sample(range(10_000), rng.randint(5, 200)) for _ in range(3)]
        sets = [set(b[: len(b) - rng.randint(0, len(b) // 5)]) | {20_000 + rng.randint(0, 500) for _ in range(rng.randint(0, 4))} for b in (rng.choice(base) for _ in range(60))]
        p = postings(sets)
        for most in (1, 4):
            monkeypatch.setattr(setjoin, "CLOSEST", most)
            for long in (False, True):
                more = np.zeros(60, bool)
                order = np.lexsort((p.n, p.key))
                got = setjoin._long_list(p, np.arange(60), more) if long else setjoin._short_lists(p, order, np.array([0]), np.array([60]), more)
                pairs = {(a, b) for x, y in got for a, b in zip(x.tolist(), y.tolist())}
                assert all(a < b for a, b in pairs)
                for b in range(60):
                    for a in range(b):
                        if X.similar(sets[a], sets[b]):
                            assert (a, b) in pairs or more[b]


def test_lines_are_cut_as_python_cuts_them():
    texts = ["a\n\nb\n", "", "\n", "x", None, "é\nü"]
    _, t = next(wordhash.slices(pa.array(texts)))
    row, number, start, end = setjoin._lines(t)
    got = [(r, k, t.data[s:e].tobytes().decode()) for r, k, s, e in zip(row.tolist(), number.tolist(), start.tolist(), end.tolist())]
    assert got == [(i, k, x) for i, text in enumerate(texts) for k, x in enumerate((text or "").split("\n"))]


def test_stages_leave_clashing_columns_as_they_are(spark, tmp_path):
    rows = X.documents()[:40] + [(600, 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" it is a line of its own', None, "s", 60)]
    extra = {"score": "0.5D", "rejected": "true", "dropped": "7", "base": "'b'", "spans": "'y'", "lang_pred": "'q'", "uid": "1L", "component": "2L"}
    df = spark.createDataFrame(rows, X.SCHEMA).selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        schema = df.schema.simpleString()
        df = stage(spark, df, str(tmp_path))
        assert df.schema.simpleString() == schema
        kept = df.select(*extra).distinct().collect()
        assert [tuple(r) for r in kept] == [(0.5, True, 7, "b", "y", "q", 1, 2)]
    text = {r["doc_id"]: r["text"] for r in df.collect()}[600]
    assert "[SECRET]" in text and "24be" not in text


def test_letters_are_those_of_category_L():
    for text in ("½ ² ①", "Ⅷ 12", "", "́ _ 1"):
        assert not language.has_letter(text)
    assert language.has_letter("12 ª") and language.has_letter("日")


def test_rejection_comes_from_what_was_held_back():
    rng = random.Random(2)
    words = {"en": ["the", "cat", "and", "dog", "sat", "with", "house"], "fr": ["le", "chat", "et", "chien", "avec", "maison", "où"]}
    rows = [(" ".join(rng.choices(w, k=rng.randint(5, 60))), lang) for lang, w in words.items() for _ in range(150)]
    model = language.train(rows)
    assert 0 < model.reject_below < 1 and 0 <= model.foreign_rejected <= 1
    right = [model.predict(t) for t, _ in rows]
    assert sum(s < model.reject_below for _, s in right) <= 0.02 * len(rows)


def test_url_verdicts_follow_words(spark):
    # Words of hosts are learned from hosts; whole and joined names hold the same words.
    good = [f"https://garden-flowers{i}.com/page/{i}" for i in range(30)]
    bad = [f"https://casino-bonus{i}.net/es/{i}" for i in range(30)]
    rows = good + bad + ["https://casino-bonus.example.org/", "https://garden-flowers.example.org/", "https://casinobonus.org/x", "https://gardenflowers.org/x"]
    df = spark.createDataFrame([(i, u, "<title>garden flowers casino bonus</title>") for i, u in enumerate(rows)], "page_id long, url string, html string")
    out = {r["page_id"]: r["verdict"] for r in urls.score_urls(spark, df).collect()}
    assert [out[60 + i] for i in range(4)] == ["block", "allow", "block", "allow"]


def test_many_secrets_in_one_text(spark):
    n = 20_000
    text = " ".join(f"password=abc{i:06d}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "plain words only")], "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in secrets.scan(df, secrets.train(spark, df)).collect()}
    assert len(got[1]) == n and got[2] == []
    assert [(s["start"], s["end"]) for s in got[1][:3]] == [(0, 18), (19, 37), (38, 56)] and got[1][-1]["end"] == len(text)


def test_markov_spans_against_the_ratio_in_python(spark):
    rng = random.Random(7)
    token = lambda n: "".join(rng.choice(secrets.ALPHABET) for _ in range(n))
    texts = [" ".join(rng.choice([token(rng.randint(6, 30)), "ordinary_words_here", "update_customer_record", "x" * 9, "password=abcdef1", f"é{token(12)}", "2024-01-02", "plain"]) for _ in range(30)) for _ in range(40)]
    texts += ["AKIA" + "A" * 16 + "zz9Qx7LpW3", "secret=" + token(20) + "!" + token(20), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = secrets.train(spark, df)
    table = [round(g * 10_000) for g in model.gains]
    code = lambda c: ord(c) - secrets.FIRST

    def ratio(run):
        codes = [0, *map(code, run)]
        return sum(table[a * secrets.CODES + b] for a, b in zip(codes, codes[1:])) / 10_000

    kinds = [(0, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), (1, r"AKIA[A-Z0-9]{16,}"), (2, r"[0-9a-f]{24,}")]
    found = 0
    for r in secrets.scan(df, model).collect():
        text = texts[r["doc_id"]] or ""
        base = sorted((m.start(), k, m.end()) for k, p in kinds for m in re.finditer(p, text) if k or len(m[2]) >= 6)
        assert [tuple(s)[:3] for s in r["base"]] == base
        view = "".join(" " if any(a <= i < b for a, _, b in base) else c for i, c in enumerate(text))
        more = [(m.start(), 3, m.end()) for m in re.finditer(secrets.CANDIDATE, view) if ratio(m[0]) > model.odds]
        assert [tuple(s)[:3] for s in r["spans"]] == sorted(base + more)
        found += len(more)
    assert found > 20


def test_tree_levels_nest_and_cover():
    rng = np.random.default_rng(1)
    x = covertree._units(np.concatenate([c + rng.normal(scale=s, size=(40, 6)) for c, s in zip(rng.normal(size=(5, 6)), (0.001, 0.01, 0.1, 0.3, 0.6))]))
    tree = covertree.Tree(x)
    above = None
    for parent, start, size, centre, reach in tree.levels:
        for s, n, c, r in zip(start, size, centre, reach):
            assert np.sqrt(np.maximum(0, 2 - 2 * tree.x[s : s + n] @ c)).max() <= r + 1e-6
        if above is not None:
            assert set(above) <= set(start)  # a centre is the centre of one of its children too
        above = start


def test_two_large_leaves_meet_in_bounded_memory():
    """Rows far apart, which radii do not rule out, beside a group of near ones."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=64) + rng.normal(scale=0.1, size=(300, 64))
    x = covertree._units(np.concatenate([rng.normal(size=(5000, 64)), near]))
    x = x[rng.permutation(len(x))]
    a, b = covertree.Tree(x[:2600]), covertree.Tree(x[2600:])
    one = np.ones(len(x), np.int64)
    for s, t, same in ((a, a, True), (a, b, False)):
        tally = covertree.Tally(one[: len(s.x)], one[: len(t.x)], same)
        tracemalloc.start()
        for found in covertree.dual_pairs(s, t, same):
            tally.add(found)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        links = s.x @ t.x.T >= covertree.THRESHOLD
        assert (tally.counts() == (links.sum(1) - 1 if same else np.concatenate([links.sum(1), links.sum(0)]))).all() and links.sum() > 2600
        assert peak < 200 << 20
