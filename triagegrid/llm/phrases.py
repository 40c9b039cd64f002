"""Phrase collocations: n-grams that stand together more often than their parts would.

Texts become pieces, identical pieces one row with its multiplicity. Pieces go in
chunks of a few megabytes. Every chunk sends the hashes of its n-grams, with their
weights, to hash buckets; a bucket counts them out-of-core in DuckDB and tells the
chunks which of theirs may be frequent. A chunk then names these n-grams alone, and
buckets of the n-grams themselves count them exactly. So the rare n-grams, which are
nearly all, never travel as strings, and a clash of hashes only lets a rare one
through to the exact count.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from hashlib import blake2b
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagegrid.llm.common import discard, ensure_workers, materialize, shared_dir
from triagegrid.llm.wordhash import Texts, mix, words

LONGEST = 3
LEAST = 10
INSIDE = 50
TOP = 2000
CHUNK = 8 << 20
HASH_BITS = 48
BUCKET_MB = 256
SALTS = 64
SCALE = 1_000_000
ENDS = r"[.,;:!?\x0A-\x0D]"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Distinct pieces of every language with their multiplicities: (lang, piece, times, n_words).

    n_words counts the words of all copies. Blanks in a piece become single spaces.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lower, ENDS, -1)).alias("piece"))
    cut = cut.withColumn("piece", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))).where("piece <> ''")
    made = cut.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))
    return made.withColumn("n_words", (F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1) * F.col("times"))


def chunks(spark: SparkSession, found: DataFrame, size: int = CHUNK) -> DataFrame:
    """pieces() in rows of about size bytes: (chunk, lang, pieces, times, n_words), pieces joined by \\n, times as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            rows = [(uuid.uuid4().int >> 65, lang, "\n".join(p), np.array(t, "<i8").tobytes(), n) for lang, (p, t, n) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64()))], names=["chunk", "lang", "pieces", "times", "n_words"])

        for b in batches:
            for lang, piece, times, n in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = held.setdefault(lang, [[], [], 0])
                own[0].append(piece)
                own[1].append(times)
                own[2] += n
                total += len(piece) + 1
                if total >= size:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return found.select("lang", "piece", "times", "n_words").mapInArrow(run, "chunk bigint, lang string, pieces string, times binary, n_words bigint")


class Grams:
    """N-grams of the pieces of one chunk: hashes, weights and places, for one length after the other."""

    def __init__(self, lang: str, text: str, times: bytes, longest: int):
        self.raw = text.encode()
        data = np.frombuffer(self.raw, np.uint8)
        starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
        found = words(Texts(data, starts.astype(np.int64)), lower=False)
        # One byte stands between a word and the next, whether a space or the end of a piece.
        self.start, self.end = found.start, np.append(found.start[1:] - 1, len(data))
        self.row, self.times = found.row, np.frombuffer(times, "<i8")
        self.hash = [found.hash + np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))]
        for k in range(2, longest + 1):
            before = self.hash[-1]
            self.hash.append(mix(before[: len(before) - 1] * np.uint64(0x9E3779B97F4A7C15) + found.hash[k - 1 :] + np.uint64(k)) if len(before) else before)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash of HASH_BITS bits and weight of every n-gram of k words."""
        n = max(0, len(self.row) - k + 1)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, mix(self.hash[k - 1][at]) >> np.uint64(64 - HASH_BITS), self.times[self.row[at]]

    def named(self, at: np.ndarray, k: int) -> pa.Array:
        """The n-grams that begin at words at, as strings."""
        lo, size = self.start[at], self.end[at + k - 1] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(self.raw, np.uint8)[np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal rank, the bytes that are all zero left out: small numbers take little and compress well."""
    table = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max((i + 1 for i in range(8) if table[i].any()), default=1)
    return bytes([width]) + table[:width].tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    width, got = raw[0], np.frombuffer(raw, np.uint8, offset=1)
    table = np.zeros((len(got) // width, 8), np.uint8)
    table[:, :width] = got.reshape(width, -1).T
    return table.view("<u8").ravel()


def packed(keys: np.ndarray) -> bytes:
    """Rising numbers as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw), dtype=np.uint64)


class Bucket:
    """A DuckDB database for one task. It spills to a folder of its own beside the other shared tables, where those are on a mounted path, and deletes it."""

    def __init__(self, folder: str, limit_mb: int = BUCKET_MB):
        import duckdb

        at = urlparse(folder)
        self.spill = Path(unquote(at.path)) / f"duckdb-{uuid.uuid4().hex}" if at.scheme in ("", "file") else None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{limit_mb}MB", "preserve_insertion_order": "false"} | ({"temp_directory": str(self.spill)} if self.spill else {"max_temp_directory_size": "0B"}))

    def __enter__(self):
        return self.db

    def __exit__(self, *_):
        self.db.close()
        if self.spill:
            shutil.rmtree(self.spill, ignore_errors=True)


def frequent_hashes(spark: SparkSession, cut: DataFrame, least: int, longest: int, buckets: int) -> DataFrame:
    """(chunk, hashes) with the n-grams of each chunk whose hash weighs least or more over all chunks, several rows a chunk."""
    folder = shared_dir(spark)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, lang, text, times in zip(*(b.column(i).to_pylist() for i in range(4))):
                made = Grams(lang, text, times, longest)
                parts = [made.of(k) for k in range(1, longest + 1)]
                keys, weights = summed(np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
                # Buckets are ranges of hashes.
                edge = np.searchsorted(keys, np.array([(i << HASH_BITS) // buckets for i in range(buckets + 1)], np.uint64))
                some = np.flatnonzero(np.diff(edge))
                spans = [slice(edge[i], edge[i + 1]) for i in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([packed(keys[s]) for s in spans], pa.binary()), pa.array([planes(weights[s]) for s in spans], pa.binary())],
                    names=["bucket", "chunk", "hashes", "weights"],
                )

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[int] = []
        with Bucket(folder) as db:
            db.execute("CREATE TABLE seen (who INTEGER, hash UBIGINT, weight BIGINT)")
            for b in batches:
                for chunk, hashes, weights in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                    keys = unpacked(hashes)
                    rows = pa.table({"who": np.full(len(keys), len(asked), np.int32), "hash": keys, "weight": unplaned(weights).astype(np.int64)})  # noqa: F841  DuckDB reads it by name
                    db.execute("INSERT INTO seen SELECT who, hash, weight FROM rows")
                    asked.append(chunk)
            often = db.sql(f"SELECT who, hash FROM seen SEMI JOIN (SELECT hash FROM seen GROUP BY hash HAVING sum(weight) >= {int(least)}) f USING (hash) ORDER BY who, hash").to_arrow_reader(1 << 16)
            for b in often:
                who, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
                edge = np.append(np.flatnonzero(np.append(True, who[1:] != who[:-1])), len(who)) if len(who) else [0]
                spans = [slice(x, y) for x, y in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([asked[who[s.start]] for s in spans], pa.int64()), pa.array([packed(keys[s]) for s in spans], pa.binary())], names=["chunk", "hashes"])

    sent = cut.select("chunk", "lang", "pieces", "times").mapInArrow(ask, "bucket int, chunk bigint, hashes binary, weights binary")
    return sent.repartitionById(buckets, "bucket").mapInArrow(reply, "chunk bigint, hashes binary")


def counts(spark: SparkSession, docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all n-grams of up to longest words that occur least times or more: (lang, k, phrase, f); and (lang, n), all words.

    Parts of a phrase occur as often as it does, so every part of a phrase that is here is here.
    """
    ensure_workers(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_dir(spark)
    cut = materialize(spark, chunks(spark, pieces(docs, text_col, lang_col), chunk), "phrase-chunks")
    told = frequent_hashes(spark, cut, least, longest, buckets)

    def name(asked: pa.Table, replies: pa.Table) -> pa.Table:
        often = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(r) for r in replies.column("hashes").to_pylist())]))
        rows = [pa.table({"lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})]
        for lang, text, times in zip(*(asked.column(c).to_pylist() for c in ("lang", "pieces", "times"))) if len(often) else ():
            made = Grams(lang, text, times, longest)
            for k in range(1, longest + 1):
                at, keys, weights = made.of(k)
                some = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
                got = pa.table({"phrase": made.named(at[some], k), "f": weights[some]}).group_by("phrase").aggregate([("f", "sum")])
                n = got.num_rows
                rows.append(pa.table({"lang": pa.array([lang] * n, pa.string()), "k": pa.array([k] * n, pa.int32()), "phrase": got.column("phrase"), "f": got.column("f_sum")}))
        return pa.concat_tables(rows)

    named = cut.select("chunk", "lang", "pieces", "times").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(name, "lang string, k int, phrase string, f bigint")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Bucket(folder) as db:
            db.execute("CREATE TABLE part (lang VARCHAR, k INTEGER, phrase VARCHAR, f BIGINT)")
            for b in batches:
                rows = pa.Table.from_batches([b])  # noqa: F841  DuckDB reads it by name
                db.execute("INSERT INTO part SELECT lang, k, phrase, f FROM rows")
            yield from db.sql(f"SELECT lang, k, phrase, CAST(sum(f) AS BIGINT) AS f FROM part GROUP BY ALL HAVING sum(f) >= {int(least)}").to_arrow_reader(1 << 14)

    exact = named.repartition(buckets, "lang", "phrase").mapInArrow(total, "lang string, k int, phrase string, f bigint")
    exact = materialize(spark, exact, "phrase-counts")
    sizes = materialize(spark, cut.groupBy("lang").agg(F.sum("n_words").alias("n")), "phrase-sizes")
    discard(spark, cut)
    return exact, sizes


def scored(candidates: DataFrame, known: DataFrame, longest: int = LONGEST, salts: int = SALTS) -> DataFrame:
    """Each candidate's lowest-scoring cut: (lang, phrase, a, l, r, score).

    Parts are looked up by requests: each distinct (part, salt) is sent to where the
    part's count is, and the answer goes back to the requests of that salt, so a part
    of very many phrases does not meet them all in one task.
    """
    ws = F.split("phrase", " ", -1)
    part = lambda k, lo, n, side: F.struct(F.lit(k).alias("cut"), F.lit(side).alias("side"), F.array_join(F.slice(ws, lo, n), " ").alias("part"))
    cuts = [F.when(F.col("k") == n, F.array(*[part(i, 1, i, "l") for i in range(1, n)], *[part(i, i + 1, n - i, "r") for i in range(1, n)])) for n in range(2, longest + 1)]
    asked = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.coalesce(*cuts)).alias("p"), F.pmod(F.xxhash64("phrase"), F.lit(salts)).alias("salt"))
    asked = asked.select("lang", "phrase", "a", "salt", "p.cut", "p.side", "p.part")
    answers = asked.select("lang", "part", "salt").distinct().join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    met = asked.join(answers, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "cut")
    both = met.agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    # 38 digits hold a * a * SCALE for every a below 10**16; score <= SCALE as l and r are at least a.
    score = F.expr(f"(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * {SCALE}BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    least = F.min(F.struct(score.cast("bigint").alias("score"), "cut", "l", "r")).alias("low")
    return both.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def covered(candidates: DataFrame, longest: int = LONGEST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase) of the candidates that stand in a longer one with at least inside percent of their count."""
    ws = F.split("phrase", " ", -1)
    # Every run of at least two words of each candidate; runs of the first word on and to the last overlap, max() does not mind.
    runs = [F.when(F.col("k") == n, F.array(*[F.array_join(F.slice(ws, lo, m), " ") for m in range(2, n) for lo in range(1, n - m + 2)])) for n in range(3, longest + 1)]
    if not runs:
        return candidates.select("lang", "phrase").where("false")
    within = candidates.select("lang", F.explode(F.coalesce(*runs)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return candidates.join(within, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("f") * inside).select("lang", "phrase")


def top(found: DataFrame, limit: int = TOP) -> DataFrame:
    """The first limit rows of each language with their rank: the best of each of several parts first, then the best of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= limit)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= limit).drop("part")


def collocations(spark: SparkSession, docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, limit: int = TOP, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK, buckets: int | None = None) -> DataFrame:
    """Each language's best phrases of 2 to longest words: (lang, rank, phrase, a, l, r, n, score).

    a is the phrase's count, l and r those of its parts at the cut that scores lowest
    (the earliest of equals), n the language's words, score = floor(1000000 a a / (l r)).
    Phrases rank by score, then a, then their bytes. Null texts and texts without words
    have no phrase; a null language is und; repeated rows count again; texts of any
    length are whole; an empty table gives no rows. Columns other than text and
    language are not read.
    """
    known, sizes = counts(spark, docs, longest, least, text_col, lang_col, chunk, buckets)
    candidates = known.where("k >= 2")
    left = candidates.join(covered(candidates, longest, inside), ["lang", "phrase"], "left_anti")
    best = top(scored(left, known, longest), limit)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
