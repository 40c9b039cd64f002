"""URL filters: rules by host and path; elsewhere naive Bayes over words that a unigram Viterbi finds in host names."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers, materialize

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS = 1 << 15
SMOOTHING = 100.0  # tokens' worth of the common distribution
PIECES = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for null and for urls without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the path's beginning; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0], r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


@dataclass
class Segmenter:
    """Log-probabilities of known words; an unknown string costs the total's logarithm and that of ten for each character."""

    words: dict[str, float]
    total: float

    def split(self, run: str) -> list[str]:
        """The most likely words of a run of letters; of equal splits the one whose last words are longer."""
        start, each = math.log(self.total), math.log(10)
        lengths = sorted({len(w) for w in self.words}, reverse=True)
        best, back = [0.0], [0]
        unknown, since = -math.inf, 0  # the best way that ends in an unknown string, and where that string begins
        for i in range(1, len(run) + 1):
            if best[i - 1] - start > unknown:
                unknown, since = best[i - 1] - start, i - 1
            unknown -= each
            top, at = -math.inf, i - 1
            for k in lengths:
                p = self.words.get(run[i - k : i]) if k <= i else None
                if p is not None and best[i - k] + p > top:
                    top, at = best[i - k] + p, i - k
            if unknown > top or unknown == top and since < at:
                top, at = unknown, since
            best.append(top)
            back.append(at)
        out, i = [], len(run)
        while i:
            out.append(run[back[i] : i])
            i = back[i]
        return out[::-1]


def fit_words(pages: DataFrame, url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(w, n): counts over all pages of runs of two letters a-z or more in titles, in host labels with a hyphen and in paths; those seen once stay unknown."""
    title = F.lower(F.regexp_extract(F.col(body_col), r"(?is)<title[^>]*>(.*?)</title>", 1))
    host, path = split_url(F.col(url_col))
    found = F.concat(
        F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[a-z]{2,}"), F.lit(0)),
        F.regexp_extract_all(host, F.lit("(?<=-)[a-z]{2,}|[a-z]{2,}(?=-)"), F.lit(0)),
        F.regexp_extract_all(F.lower(path), F.lit("[a-z]{2,}"), F.lit(0)),
    )
    return pages.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def segment_runs(spark: SparkSession, runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of the distinct runs of letters in runs(run), by the word counts(w, n).

    Every run meets the counts of its own substrings in a join, so the lexicon has
    no bound and is never broadcast; only lengths that some word has are cut out.
    """
    about = counts.agg(F.sum("n").alias("total"), F.collect_set(F.length("w")).alias("lengths")).first()
    total, lengths = max(float(about["total"] or 0), 10.0), sorted(about["lengths"])
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.length("run") - k + 1), lambda i: F.substring(F.col("run"), i, k))
    subs = F.flatten(F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("run")), starts))
    parts = runs.select("run", F.explode(F.array_distinct(subs)).alias("w")) if lengths else runs.select("run", F.lit("").alias("w")).limit(0)
    known = parts.join(counts, "w").groupBy("run").agg(F.collect_list(F.struct("w", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [Segmenter({x["w"]: math.log(x["n"] / total) for x in known or ()}, total).split(run) for run, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["run", "words"])

    return runs.join(known, "run", "left").select("run", "known").mapInArrow(split, "run string, words array<string>")


def host_tokens(spark: SparkSession, hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, tokens) of the distinct hosts: words of their runs of letters, one token for each run of digits, other runs whole."""
    kinds = F.regexp_extract_all("host", F.lit(r"[a-z]+|[0-9]+|[^\x00-\x7f]+"), F.lit(0))
    parts = materialize(spark, hosts.select("host", F.explode(kinds).alias("run")), "url-runs")
    words = segment_runs(spark, parts.select("run").where(F.col("run").rlike("^[a-z]")).distinct(), counts)
    own = F.when(F.col("run").rlike("^[0-9]"), F.array(F.lit("#"))).otherwise(F.coalesce("words", F.array("run")))
    met = parts.join(words, "run", "left").select("host", F.transform(own, lambda w: F.concat(F.lit("w:"), w)).alias("tokens"))
    return met.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def path_tokens(path: str) -> list[str]:
    """Runs of letters of a path; digits count as one token."""
    return ["p:#" if run[0].isdigit() else "p:" + run for run in PIECES.findall(path.lower())]


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


def score_urls(spark: SparkSession, pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", learn: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds) for every page.

    A rule's verdict stands. Elsewhere multinomial naive Bayes decides by the
    words of host and path alone, block and allow being equally likely before
    them: log_odds > 0 is block, a tie allow. It is trained on all pages that a
    rule decides (of those that `learn` names), their verdict the label. Token counts
    go to BUCKETS hash buckets, so the model has one size. Null urls and urls
    without :// have an empty host and path and are judged like any other; with no
    rule-decided page the verdict is allow. Repeated rows give repeated results;
    an empty table gives no rows; columns other than the three are not read. Of
    equally likely splits of a host that with longer last words is taken; a long
    host costs in proportion to its length.
    """
    ensure_workers(spark)
    host, path = split_url(F.col(url_col))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    src = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(True) if learn is None else learn).alias("learn"))
    src = src.withColumn("rule", rule).withColumn("label", verdict)
    per_host = materialize(spark, src.groupBy("host", F.when(F.col("learn"), F.col("label")).alias("label")).agg(F.count(F.lit(1)).alias("n")), "url-hosts")
    words = materialize(spark, host_tokens(spark, per_host.select("host").distinct(), materialize(spark, fit_words(pages, url_col, body_col), "url-words")), "url-tokens")

    def count(tokens_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[str, np.ndarray] = {}
            for b in batches:
                for label, value, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                    own = counts.setdefault(label, np.zeros(BUCKETS, np.int64))
                    for t in tokens_of(value):
                        own[_bucket(t)] += n
            for label, own in counts.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["label", "bucket", "n"])

        return run

    kinds = "label string, bucket int, n bigint"
    seen = per_host.where("label is not null").join(words, "host").select("label", "tokens", "n").mapInArrow(count(list), kinds)
    paths = src.where("learn and label is not null").select("label", "path", F.lit(1).cast("bigint").alias("n")).mapInArrow(count(path_tokens), kinds)
    table = {"allow": np.zeros(BUCKETS), "block": np.zeros(BUCKETS)}
    for r in seen.union(paths).groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect():
        table[r["label"]][r["bucket"]] = r["n"]
    # Both are smoothed towards their common distribution, so neither gains by having more pages, and a word that neither knows says nothing.
    share = {k: v / max(v.sum(), 1.0) for k, v in table.items()}
    seen_labels = [v for k, v in share.items() if table[k].any()]
    common = sum(seen_labels) / len(seen_labels) if seen_labels else np.zeros(BUCKETS)
    p = {k: (v + SMOOTHING * common) / (v.sum() + SMOOTHING) for k, v in table.items()}
    known = common > 0
    gains = spark.sparkContext.broadcast(np.where(known, np.log(np.where(known, p["block"], 1.0)) - np.log(np.where(known, p["allow"], 1.0)), 0.0))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for b in batches:
            got = [float(sum(gain[_bucket(t)] for t in [*(w or ()), *path_tokens(p)])) for p, w in zip(b.column(2).to_pylist(), b.column(5).to_pylist())]
            said = [label or ("block" if s > 0 else "allow") for label, s in zip(b.column(4).to_pylist(), got)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(said, pa.string()), pa.array(got, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "log_odds"])

    kind = src.schema["page_id"].dataType.simpleString()
    met = src.join(words, "host", "left").select("page_id", "host", "path", "rule", "label", "tokens")
    return met.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, log_odds double")
