"""Sharding: linked documents together, shards of equal size, by balanced label propagation.

Every row starts in a shard of its own hash. In each round rows look at the shards
of the rows they are linked with and want to move where most of these are; quotas
that keep every shard under its capacity say how many may. What is not linked
fills the shards up, so their sizes come out even.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import discard, materialize

SHARDS = 8
ROUNDS = 16
SETTLED = 0.0001
HOT_SHARE = 20_000
HOT_LEAST = 4096


def salted(links: DataFrame, rows: int, share: int = HOT_SHARE, least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame]:
    """(links with a salt, (hub, salts) of the hubs that are cut), so that no key of a join holds more than rows / share rows, or least.

    There are at most share such hubs, so they are broadcast.
    """
    block = max(least, math.ceil(rows / share))
    hot = links.groupBy("hub").count().where(F.col("count") > block).select("hub", F.ceil(F.col("count") / block).cast("int").alias("salts"))
    cut = links.join(F.broadcast(hot), "hub", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"), F.lit(0)))
    return cut.drop("salts"), hot


def quotas(wish: np.ndarray, sizes: np.ndarray, capacity: float) -> np.ndarray:
    """Share of each wish [from, to, gain class] that is granted: higher gains first, no shard above capacity.

    All wishes are granted at first. A shard that would be too full takes fewer,
    which leaves more in the shards these would have come from; so this goes on
    until every shard fits. Shards that change rows with each other both keep
    what they exchange.
    """
    shards, classes = len(sizes), wish.shape[2]
    share = np.ones_like(wish, float)
    while True:
        granted = wish * share
        after = sizes + granted.sum((0, 2)) - granted.sum((1, 2))
        over = np.flatnonzero(after > capacity + 1e-6)
        over = over[granted[:, over].sum((0, 2)) > 1e-6]
        if not len(over):
            return share
        for t in over:
            room = max(0.0, granted[:, t].sum() - (after[t] - capacity))
            for g in range(classes - 1, -1, -1):
                want = granted[:, t, g].sum()
                take = min(want, room)
                share[:, t, g] *= take / want if want else 0.0
                room -= take


def propagate(spark: SparkSession, links: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = 0.01, share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """Labels of the rows of links(row, hub): (row, label), label below shards.

    Rows with a hub in common are linked. rows is the number of all rows, linked or
    not, and sets the capacity. A row wants the label that most of its neighbours have,
    the smallest of equals, if more have it than its own. So that rows do not change
    places for ever, those that win by one ask in turn for smaller and for larger labels
    only, and of the others one in eight waits, by a hash of row and round. A label that could not take all that asked is left out of wishes
    until nothing moves any more, which lets the rest of a large group gather elsewhere. It ends when two
    rounds with all labels move fewer than SETTLED of the rows, or after rounds. A round counts labels
    per hub (at most shards numbers for each, whatever its size) and sends them back
    to its rows.
    """
    cut, hot = salted(links.select("row", "hub").distinct(), rows, share, least)
    cut = materialize(spark, cut, "shard-links")
    hot = materialize(spark, hot, "shard-hot")
    labels = materialize(spark, cut.select("row").distinct().withColumn("label", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "shard-labels")
    capacity = (1 + slack) * rows / shards
    closed: set[int] = set()
    calm = 0
    own = lambda s: F.sum(F.when(F.col("label") == s, 1).otherwise(0))
    for turn in range(rounds):
        seen = cut.join(labels, "row")
        held = seen.groupBy("hub").agg(F.array(*[own(s) for s in range(shards)]).alias("held"))
        # Of a hot hub every salt gets the counts.
        spread = held.join(F.broadcast(hot), "hub", "left").select("hub", "held", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        votes = seen.join(spread, ["hub", "salt"]).groupBy("row", "label").agg(*[F.sum(F.col("held")[s] - (F.col("label") == s).cast("int")).alias(f"v{s}") for s in range(shards)])
        open_ = [s for s in range(shards) if s not in closed] or list(range(shards))
        most = F.greatest(*[F.col(f"v{s}") for s in open_], *[F.lit(-1)] * 2)
        to = F.coalesce(*[F.when(F.col(f"v{s}") == most, s) for s in open_])
        mine = F.coalesce(*[F.when(F.col("label") == s, F.col(f"v{s}")) for s in range(shards)])
        gain = most - mine
        asks = F.when(gain == 1, to < F.col("label") if turn % 2 == 0 else to > F.col("label")).otherwise((gain > 1) & (F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(8)) > 0))
        wish = votes.select("row", "label", F.when(asks, to).alias("to"), F.when(asks, F.floor(F.log2(gain))).cast("int").alias("class"))
        wish = materialize(spark, wish, "shard-wishes")
        # At most shards x shards x 64 numbers.
        table = wish.groupBy("label", "to", "class").count().collect()
        sizes, asked = np.zeros(shards), np.zeros((shards, shards, 64))
        for r in table:
            sizes[r["label"]] += r["count"]
            if r["to"] is not None:
                asked[r["label"], r["to"], r["class"]] += r["count"]
        part = quotas(asked, sizes, capacity)
        moved = (asked * part).sum()
        still = moved <= SETTLED * sizes.sum()
        calm = calm + 1 if still and not closed else 0 if not still else calm
        closed = set() if still else closed | {t for t in range(shards) if asked[:, t].sum() > (asked * part)[:, t].sum() + 0.5}
        said = [(s, t, g, float(part[s, t, g])) for s, t, g in zip(*np.nonzero(asked * part))]
        granted = spark.createDataFrame([(int(s), int(t), int(g), p) for s, t, g, p in said], "label int, to int, class int, part double")
        lot = F.pmod(F.xxhash64("row", F.lit(turn), F.lit("lot")), F.lit(1 << 30)) / (1 << 30)
        new = wish.join(F.broadcast(granted), ["label", "to", "class"], "left").select("row", F.when(lot < F.col("part"), F.col("to")).otherwise(F.col("label")).alias("label"))
        new = materialize(spark, new, "shard-labels")
        discard(spark, labels)
        discard(spark, wish)
        labels = new
        if calm == 2:
            break
    return labels


def even(spark: SparkSession, placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """placed(row, ..., label or null) with shard and slot instead of label: shard sizes differ by one at most, slots run from 0.

    Rows keep their label as far as its shard has room; the others and those without
    one fill the gaps. Rows are numbered in two steps, counts per partition and label
    first, so nothing is sorted or gathered.
    """
    out = [c for c in placed.columns if c != "label"]
    sorted_ = placed.withColumn("label", F.coalesce("label", F.lit(shards))).sortWithinPartitions("label")
    numbered = materialize(spark, sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), "shard-numbered")
    # A row for each partition and label.
    counts = numbered.groupBy("__part", "label").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).orderBy("__part").collect()
    total, base = [0] * (shards + 1), []
    for r in counts:
        base.append((r["__part"], r["label"], total[r["label"]] - r["first"]))
        total[r["label"]] += r["n"]
    rows = sum(total)
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    kept = [min(t, r) for t, r in zip(total, room)]
    # Rows over a shard's room come after those without a label; gaps are filled shard by shard.
    pool = [total[shards]]
    for s in range(shards):
        pool.append(pool[-1] + total[s] - kept[s])
    gap = [0]
    for s in range(shards):
        gap.append(gap[-1] + room[s] - kept[s])
    bases = spark.createDataFrame(base, "__part int, label int, __base bigint")
    lit = lambda values: F.array(*[F.lit(int(v)).cast("bigint") for v in values])
    nth = F.col("__at") + F.col("__base")
    own = (F.col("label") < shards) & (F.col("__nth") < lit([*kept, 0])[F.col("label")])
    waits = F.when(F.col("label") == shards, F.col("__nth")).otherwise(lit([*pool[:shards], 0])[F.col("label")] + F.col("__nth") - lit([*kept, 0])[F.col("label")])
    to = F.coalesce(*[F.when(F.col("__wait") < gap[s + 1], s) for s in range(shards)])
    found = numbered.join(F.broadcast(bases), ["__part", "label"]).withColumn("__nth", nth)
    found = found.withColumn("__wait", F.when(~own, waits)).withColumn("shard", F.when(F.col("__wait").isNull(), F.col("label")).otherwise(to).cast("int"))
    slot = F.when(F.col("__wait").isNull(), F.col("__nth")).otherwise(lit(kept)[F.col("shard")] + F.col("__wait") - lit(gap[:shards])[F.col("shard")])
    return found.select(*out, "shard", slot.alias("slot"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard: (doc_id, size, text_crc32, law, shard, slot, grown_shard), law rows.

    Row counts of shards differ by one at most; rows with equal texts are linked and go
    together as far as a shard has room, and a group larger than a shard is spread over
    as few as propagation finds. Null text counts as empty (size 1). Rows that repeat
    an id are rows of their own, null ids are kept; only digests of texts of any length
    are moved; an empty table gives no rows; other columns are not read.
    grown_shard is null, as this law says nothing of one more shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub"))
    made = materialize(spark, made.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    hubs = made.groupBy("hub").count().where("count > 1").select("hub")
    links = materialize(spark, made.select("row", "hub").join(hubs, "hub").select("row", "hub"), "shard-hubs")
    labels = propagate(spark, links, made.count(), shards, rounds)
    done = even(spark, made.drop("hub").join(labels, "row", "left").drop("row"), shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
