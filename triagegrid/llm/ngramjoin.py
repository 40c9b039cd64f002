"""N-gram Jaccard join: light sets meet in fixed-size subsets of their prefixes, heavy ones in inverted lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm import setjoin, wordhash
from triagegrid.llm.common import connected_components, materialize

WORDS = 5
BITS = 20
ROUNDS = 2
DEALT = 512
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: wordhash.Texts) -> setjoin.Sets:
    """Hashes of each text's 5-word shingles; of fewer words the whole sequence as one. Texts without words have no set."""
    w = wordhash.words(texts)
    number = np.bincount(w.row, minlength=len(texts.offsets) - 1)
    first = np.cumsum(number) - number
    rows, hashes = [], []
    for size in range(1, WORDS + 1):
        if size < WORDS:
            at = first[number == size]
        else:
            at = np.arange(max(0, len(w.row) - WORDS + 1))
            at = at[w.row[at] == w.row[at + WORDS - 1]]
        h = w.hash[at] + np.uint64(size)
        for i in range(1, size):
            h = (h ^ (h >> np.uint64(29))) * PRIME + w.hash[at + i]
        rows.append(w.row[at])
        hashes.append(wordhash.mix(h))
    full = np.flatnonzero(number)
    item = np.cumsum(number > 0) - 1
    return setjoin.Sets(full, np.zeros(len(full), np.int64), item[np.concatenate(rows)], np.concatenate(hashes))


def light_boundary(counts: np.ndarray) -> int:
    """Size under which a set is light, chosen by cost.

    A light set with a prefix of p tokens writes p (p + 1) / 2 subsets; in
    inverted lists it writes p tokens and scans p lists. The length of a list is
    estimated at the rarest quarter of all occurrences, from which prefixes come,
    less what buckets hold by chance. Subsets are cheaper up to p = 1 + 2 * length.
    """
    total = counts.sum()
    if not total:
        return 0
    by_count = np.sort(counts[counts > 0])
    quarter = by_count[np.searchsorted(np.cumsum(by_count), total / 4)]
    length = max(1.0, float(quarter - counts.mean()))
    n = np.arange(1, 100_000)
    return int(n[setjoin.prefix_size(n) <= 1 + 2 * length].max()) + 1


def dealt(lists: DataFrame, size: int = DEALT) -> tuple[DataFrame, DataFrame]:
    """lists twice, so that joined by key every two members of a list meet once, in groups of about size members of either side.

    Long lists are cut into parts by hash; a group is a part of the one side and a part of the other.
    """
    parts = lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__parts"))
    cut = lists.join(parts, "key").withColumn("__own", F.pmod(F.xxhash64("a_hi", "a_lo"), F.col("__parts")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts").cast("bigint") - 1))
    left, right = (cut.withColumn("__other", every).withColumn("key", F.xxhash64("key", *order)).select(lists.columns) for order in (("__own", "__other"), ("__other", "__own")))
    return left, right


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents by Jaccard similarity of 3/4 or more of their 5-word shingles.

    One row per row of docs: (doc_id, n_shingles, component_id), the smallest id
    that links reach. Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased. Null, empty
    and wordless texts have no shingles and no links. A null id has no links and
    a null component; rows that repeat an id share its links. An empty table gives
    no rows; columns other than id and text are not read. Texts of any length are
    cut whole; at exactly 3/4 two documents link.

    Every document meets all others in short lists and the first of long ones.
    What then still lies in different classes of one list meets again: twice one
    member per class against the list's first, then all that is left, dealt over
    parts of the list.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("hi"), F.col(text_col).alias("text"))
    rarity, counts, sizes = setjoin.count_tokens(spark, src, shingle_sets, BITS)
    named = src.where("hi is not null")
    light = setjoin.Subsets(((light_boundary(counts), 2),), (-np.inf, np.inf))
    found = setjoin.join_candidates(spark, named, shingle_sets, rarity, light, base_first=True, short=16)
    pairs = found.where("kind = 'pair'").select("a_hi", "a_lo", "b_hi", "b_lo", "sure")
    sure = pairs.where("sure").select("a_hi", "b_hi").distinct()
    rest = pairs.where("not sure").drop("sure").distinct()
    sets = setjoin.fetch_sets(spark, named, setjoin.items_of(found), shingle_sets, rarity)
    near = setjoin.similar_pairs(spark, rest, sets).select("a_hi", "b_hi")
    links = materialize(spark, sure.union(near).toDF("a", "b"), "ngram-links")
    classes = connected_components(spark, links)
    lists = found.where("kind = 'list'").select("key", "a_hi", "a_lo", "pos", "n", "b0", "b1")
    for turn in range(ROUNDS + 1):
        if lists.isEmpty():
            break
        label = classes.select(F.col("node").alias("a_hi"), "component")
        known = lists.join(label, "a_hi", "left").withColumn("label", F.coalesce("component", "a_hi")).drop("component")
        mixed = known.groupBy("key").agg(F.min("label").alias("lo_label"), F.max("label").alias("hi_label")).where("lo_label < hi_label").select("key")
        known = materialize(spark, known.join(mixed, "key", "left_semi"), "ngram-mixed")
        if known.isEmpty():
            break
        lists = known.drop("label")
        if turn < ROUNDS:
            every = F.struct("pos", "a_hi", "a_lo", "n", "b0", "b1", "label")
            one = known.groupBy("key", "label").agg(F.min(every).alias("m")).select("key", "m.*")
            head = one.groupBy("key").agg(F.min(F.struct("pos", "a_hi", "a_lo", "n", "b0", "b1", "label")).alias("m")).select("key", "m.*")
            again = setjoin.overlapping(head, one, F.col("label") != F.col("ylabel"))
        else:
            again = setjoin.overlapping(*dealt(known), (F.col("label") < F.col("ylabel")))
        new = setjoin.similar_pairs(spark, again, sets).select(F.col("a_hi").alias("a"), F.col("b_hi").alias("b"))
        links = materialize(spark, links.union(new), "ngram-links")
        classes = connected_components(spark, links)
    out = sizes.join(classes.select(F.col("node").alias("hi"), "component"), "hi", "left")
    return out.select(F.col("hi").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "hi").alias("component_id"))
