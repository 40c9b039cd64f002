import collections

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import fixtures as X
from triagegrid.llm import language, secrets


def test_run_against_brute_force(spark, tmp_path):
    rows = X.documents() + [(500, 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" it is', "en", "s", 60), (501, "12345", "en", "s", 5)]
    spark.createDataFrame(rows, X.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    model = language.fit_languages(docs)
    left = []
    for i, t, *_ in rows:
        lang, score = model.predict(t)
        if lang != "und" and score >= model.reject_below:
            left.append((i, t))
    gone = X.later_lines(left)
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in left]
    left = [(i, t) for i, t in left if t.split() or i not in gone]
    sets = {i: X.shingles(t) for i, t in left}
    comp = X.components(list(sets), [(a, b) for a in sets for b in sets if a < b and X.similar(sets[a], sets[b])])
    left = {i: t for i, t in left if comp[i] == i}
    df = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    masked = secrets.scan(df, secrets.train(spark, df), keep=("text",)).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: tok.encode(r["t"], add_special_tokens=False).ids + [1] for r in masked.collect()}
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in by.items()} == want
    assert 500 in want and 501 not in want and "[SECRET]" in tok.decode(want[500])


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    for df in (X.frame(spark), X.frame(spark, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() >= 0
