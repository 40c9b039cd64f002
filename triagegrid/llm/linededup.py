"""Line dedup: an exact set-similarity join of lines; a line goes when an earlier one is similar to it."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm import setjoin, wordhash
from triagegrid.llm.common import materialize, number_texts, text_digest

MIN_TOKENS = 3
BITS = 22
LIST = 1000.0  # a key gets one more word where its list is expected to be longer: then comparing costs as much as writing the list


def line_sets(texts: wordhash.Texts, least: int = MIN_TOKENS) -> setjoin.Sets:
    """Word hashes of every line of at least `least` words."""
    w = wordhash.words(texts)
    line = wordhash.line_numbers(texts, w)
    if not len(line):
        return setjoin.Sets(w.row, line, line, w.hash)
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])
    of = np.cumsum(new) - 1
    long = np.bincount(of) >= least
    keep = long[of]
    first = np.flatnonzero(new)[long]
    return setjoin.Sets(w.row[first], line[first], (np.cumsum(long) - 1)[of[keep]], w.hash[keep])


def repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_TOKENS) -> DataFrame:
    """Lines with a similar line before them: (hi, los) is a document's id and its lines' numbers from 0.

    Lines are cut at \\n; a line is the set of its words [^\\x20\\x09-\\x0D]+ with
    A-Z lower-cased. Lines of fewer than `least` words never match; with 1
    all but blank lines take part, and those of one or two distinct words match equal
    sets alone, as 3/4 asks. A line matches an earlier one, by
    (id, line number), if the Jaccard similarity of the sets is 3/4 or more,
    whether the earlier one stays or not. Null text has no lines. Lines of rows
    with a null id are left alone; rows that repeat an id and its text count as one
    document, whose lines do not match themselves. Different texts of one id are
    documents of their own, one after the other by their digest; where any id
    repeats, the column `digest` says which text of the id the numbers belong to.
    An empty table gives no rows; columns other than id and text are not read.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("hi"), F.col(text_col).alias("text")).where("hi is not null")
    names = number_texts(spark, src, "hi")
    if names is not None:
        told = src.withColumn("digest", text_digest()).join(names, ["hi", "digest"])
        src = materialize(spark, told.select(F.col("uid").alias("hi"), "text").dropDuplicates(["hi"]), "line-texts")
    cut = partial(line_sets, least=least)
    rarity, _, _ = setjoin.count_tokens(spark, src, cut, BITS, distinct=False)
    plan = setjoin.Lengths(LIST, rarity.sets)
    found = setjoin.close_pairs(spark, src, cut, rarity, plan, unique_is_zero=True)
    pairs = found.where("lists is null")
    equal = materialize(spark, pairs.where("sure").select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo")).distinct(), "line-equal")
    # A line with an equal line before it needs no other reason to go.
    told = equal.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    near = pairs.where("not sure").groupBy("b_hi", "b_lo", "a_hi", "a_lo").agg(F.max("more").alias("more")).join(told, ["b_hi", "b_lo"], "left_anti")
    near = materialize(spark, near, "line-candidates")
    gone = equal.union(_verified(spark, src, near.where("a_hi is not null").drop("more"), cut, rarity))
    gone = materialize(spark, gone.distinct(), "line-gone")
    # Lines of which no candidate was similar and that have others.
    left = near.where("more").select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo")).distinct().join(gone, ["hi", "lo"], "left_anti")
    if not left.isEmpty():
        gone = gone.union(setjoin.open_matches(spark, src, found, left, cut, rarity, plan, unique_is_zero=True, by_line=True))
    out = gone.groupBy("hi").agg(F.array_sort(F.collect_set("lo")).alias("los"))
    if names is None:
        return out
    return out.withColumnRenamed("hi", "uid").join(names, "uid").select("hi", "los", "digest")


def _verified(spark: SparkSession, src: DataFrame, pairs: DataFrame, cut: setjoin.SetsOf, rarity: setjoin.Rarity) -> DataFrame:
    """(hi, lo) of the later lines of the pairs that are similar."""
    ends = pairs.select(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).union(pairs.select("b_hi", "b_lo")).distinct()
    sets = setjoin.fetch_sets(spark, src, ends, cut, rarity, by_line=True)
    return setjoin.similar_pairs(spark, pairs, sets).select(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo"))


def with_gone(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the column __los: the numbers in gone of every row's lines, null where none goes."""
    told = [F.col("digest").alias("__digest")] if "digest" in gone.columns else []
    right = gone.select(F.col("hi").alias("__hi"), F.col("los").alias("__los"), *told)
    same = F.col(id_col).cast("bigint") == F.col("__hi")
    if told:
        docs = docs.withColumn("__own", text_digest(text_col))
        same &= F.col("__own") == F.col("__digest")
    return docs.join(right, same, "left").drop("__hi", "__digest", "__own")


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: str = "dropped") -> DataFrame:
    """docs without the lines that repeated_lines() found, with the column `dropped`, or as named: how many went from the row.

    Null text stays null, an empty table empty; columns named __los, __hi, __digest or __own are not allowed.
    """
    names = docs.columns
    all_ = with_gone(docs, gone, id_col, text_col)
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__los"), i)), "\n")
    text = F.when(F.col("__los").isNull(), F.col(text_col)).otherwise(kept)
    return all_.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], F.coalesce(F.size("__los"), F.lit(0)).alias(dropped))
