"""Packing: concatenate and cut. Prefix sums over partition totals give every document its global offset."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers, frugal, materialize

WINDOW = 2048
END_ID = 1


@lru_cache(4)
def encoder(path: str, added: bool = False):
    """Encoder for a byte-level BPE vocabulary file of the tokenizers library.

    The ids are those of that library's own encoder (a test holds the two
    against each other); tiktoken takes a fifth of its time. With added, the
    file's added tokens have their own ids wherever they stand in a text, as by the
    library's default; without, they are ordinary text, as with encode_special_tokens.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    vocab, own = read["model"]["vocab"], {}
    if added:
        if any(t[k] for t in read["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that match by more than their text")
        own = {t["content"]: t["id"] for t in read["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if all(c in byte_of for c in piece)}
    ranks = {k: v for k, v in ranks.items() if not k.startswith(b"<|endoftext|>")}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)


def tokenize(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, added: bool = False) -> DataFrame:
    """First pass: (id, part, local_start, n, ids) with ids as little-endian unsigned 16-bit numbers.

    local_start counts the ids before the document within its input partition.
    """
    ensure_workers(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path, added), TaskContext.get().partitionId(), 0
        for b in batches:
            starts, sizes, blobs = [], [], []
            for t in b.column(1):
                ids = enc.encode(t.as_py() or "", allowed_special="all", disallowed_special=())
                ids.append(end_id)
                starts.append(at)
                sizes.append(len(ids))
                blobs.append(np.array(ids, "<u2").tobytes())
                at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "part", "local_start", "n", "ids"],
            )

    return src.mapInArrow(frugal(run), f"doc_id {kind}, part int, local_start bigint, n bigint, ids binary")


def pack(spark: SparkSession, docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, added: bool = False) -> DataFrame:
    """Cut the concatenation of all documents into sequences of window ids: one row per piece.

    (doc_id, start, length, ids, doc_tokens, sequence_id, offset): ids holds the
    piece as little-endian unsigned 32-bit numbers. A document that crosses a
    window's edge gives one row on either side. Null or empty text is the end id
    alone; repeated rows are packed again; an empty table packs to nothing. Only
    the last sequence is short. Two passes: the tokens are written once to the
    shared folder with their place in their partition, then the totals of the
    partitions, one row each, are summed up and every piece finds its place
    without a shuffle of tokens. Null ids are kept; a text of any length is one
    document; columns other than id and text are not read, so their names cannot clash.
    """
    done = materialize(spark, tokenize(spark, docs, path, id_col, text_col, end_id, added), "pack-ids")
    totals = done.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = done.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("at"), "n", "ids")
    kind = placed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc, at, n, blob in zip(*(b.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(blob, "<u2").astype("<u4")
                lo = 0
                while lo < n:
                    seq, off = divmod(at + lo, window)
                    hi = min(n, lo + window - off)
                    for r, v in zip(rows, (doc, lo, hi - lo, ids[lo:hi].tobytes(), n, seq, off)):
                        r.append(v)
                    lo = hi
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], b.schema.field(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), *(pa.array(r, pa.int64()) for r in rows[4:])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return placed.mapInArrow(frugal(run), f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
