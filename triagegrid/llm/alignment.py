"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over a corpus.

Both tokenizers cut a text's bytes; where both cut, a group of tokens ends. Two tokens
are linked if their bytes overlap. Pairs of ids are packed into one int64. Partitions
count them in part, a global sort by range brings equal keys together, run lengths are
summed into sorted shards, and documents look their pairs up in the mapped shards.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers, materialize, shared_dir
from triagegrid.llm.packing import encoder
from triagegrid.llm.phrases import packed, planes, summed, unpacked, unplaned

SPACE = "▁"
SIDE = 32
BATCH_BYTES = 8 << 20
HELD = 4 << 20
LOOKUP = 1 << 20
STRETCH = re.compile(" *[^ ]+| +")
REMEMBERED = 400_000
LONG = 64


class Side(NamedTuple):
    """A tokenizer's table: bytes of every id, their lengths, and the ids as text before , and at the end of a group."""

    table: list[bytes]
    sizes: np.ndarray
    inner: list[str]
    last: list[str]


def side(table: list[bytes], mark: str) -> Side:
    return Side(table, np.array([len(b) for b in table], np.int64), [f"{i}," for i in range(len(table))], [f"{i}{mark}" for i in range(len(table))])


@lru_cache(2)
def byte_side(path: str) -> Side:
    """Token bytes of a byte-level vocabulary file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    enc = encoder(path)
    table = [b""] * (1 + max([*read["model"]["vocab"].values(), *(t["id"] for t in read["added_tokens"])]))
    for raw, i in enc._mergeable_ranks.items():
        table[i] = raw
    return side(table, "|")


class Pieces:
    """A sentencepiece model, its token bytes (a piece's UTF-8 with the space mark as a space, a byte piece's byte), and the stretches met so far.

    Where no piece has a space mark behind another character, nothing is joined across
    the end of a word, so a text is encoded stretch by stretch (spaces and a word), and
    what was met before is remembered. Stretches of more than LONG characters and models
    with other pieces go through the library each time.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        text = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.side = side([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(text)], ";")
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in text)
        self.met: dict[str, list[int] | None] = {}

    def whole(self, text: str) -> list[int] | None:
        """Ids of text, before which the model puts a space; null if they do not spell it. Of no text that is the space alone, which the library leaves out."""
        ids = self.model.encode(text) if text else [self.model.piece_to_id(SPACE)]
        return ids if b"".join([self.side.table[i] for i in ids]) == b" " + text.encode() else None

    def encode(self, text: str) -> list[int] | None:
        if not self.apart:
            return self.whole(text)
        out: list[int] = []
        for stretch in STRETCH.findall(" " + text):
            ids = self.met.get(stretch, out)
            if ids is out:
                ids = self.whole(stretch[1:])
                if len(stretch) <= LONG:
                    if len(self.met) >= REMEMBERED:
                        self.met.clear()
                    self.met[stretch] = ids
            if ids is None:
                return None
            out += ids
        return out


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Aligned(NamedTuple):
    n_groups: int
    keys: np.ndarray
    groups: str


def align(a: np.ndarray, b: np.ndarray, left: Side, right: Side) -> Aligned:
    """Two token sequences over the same bytes: the number of groups, a packed key for every link, the groups as text."""
    ends_a, ends_b = np.cumsum(left.sizes[a]), np.cumsum(right.sizes[b])
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    again = np.append(both[1:] == both[:-1], False)
    # Between two neighbouring ends of either side lies one link, as two runs of bytes overlap in one run.
    every, shared = both[~again], both[again]
    keys = a[np.searchsorted(ends_a, every)] << SIDE | b[np.searchsorted(ends_b, every)]
    of_a, of_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
    before = np.append(0, np.searchsorted(ends_b, shared, "right"))
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + before[of_a]] = np.where(shared[of_a] == ends_a, len(left.table), 0) + a
    base = 2 * len(left.table)
    order[np.arange(len(b)) + np.searchsorted(ends_a, shared, "right")[of_b]] = base + np.where(shared[of_b] == ends_b, len(right.table), 0) + b
    names = _names(left, right)
    return Aligned(len(shared), keys, "".join(map(names.__getitem__, order.tolist()))[:-1])


_named: dict[tuple[int, int], list[str]] = {}


def _names(left: Side, right: Side) -> list[str]:
    key = id(left), id(right)
    if key not in _named:
        _named.clear()
        _named[key] = [*left.inner, *left.last, *right.inner, *right.last]
    return _named[key]


def encode(spark: SparkSession, docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document in both tokenizers: (doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times).

    A is the byte-level vocabulary on a space and the text, B the piece model, which
    adds the space itself. groups is `a1,a2|b1;a3|b2,b3`, ids in order. pairs holds the
    distinct packed pairs (A id << 32 | B id) of the links, times how many links have
    each, both packed. Null and empty texts, and those of which a tokenizer does not
    keep every byte, have no tokens: zeros, and groups null. Strings of special tokens
    are ordinary text. A text of any length is one document; repeated rows are documents
    of their own; null ids are kept; other columns are not read.
    """
    ensure_workers(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, left = encoder(byte_path), byte_side(byte_path)
        pieces = pieces_of(piece_path)
        right = pieces.side
        rows: list[tuple] = []
        for batch in batches:
            held = 0
            for i, text in enumerate(batch.column(1)):
                row = (0, 0, 0, 0, None, b"", b"")
                if text := text.as_py() or "":
                    a, b = enc.encode_ordinary(" " + text), pieces.encode(text)
                    if b is not None and enc.decode_bytes(a) == b" " + text.encode():
                        got = align(np.array(a, np.int64), np.array(b, np.int64), left, right)
                        keys, times = np.unique(got.keys, return_counts=True)
                        row = len(a), len(b), got.n_groups, len(got.keys), got.groups, packed(keys.astype(np.uint64)), planes(times)
                        held += len(got.groups)
                rows.append(row)
                if held >= BATCH_BYTES:
                    yield _batch(batch.column(0).slice(i + 1 - len(rows), len(rows)), rows)
                    rows, held = [], 0
            if rows:
                yield _batch(batch.column(0).slice(len(batch) - len(rows)), rows)
                rows = []

    return src.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary")


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])


class Counts(NamedTuple):
    """Sorted shards of pair keys with the number of documents that hold each: files, their first keys; and each A id's highest number."""

    paths: list[str]
    firsts: np.ndarray
    highest: np.ndarray


def pair_counts(spark: SparkSession, aligned: DataFrame, folder: str | None = None) -> Counts:
    """How many documents of encode() hold each pair, in shards that together are sorted.

    Each partition sums up what it has with np.unique, at most HELD keys at a time. The
    partial counts are sorted by range of keys and run lengths are summed while each
    range is written as two files, keys and counts. The driver gets a row per shard,
    with the highest count of every A id in it, so no more than shards and ids.
    """
    folder = folder or f"{shared_dir(spark)}/pair-counts-{uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            got, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return summed(np.concatenate([keys, got]), np.concatenate([n, times]))

        for b in batches:
            for raw in b.column(0):
                if raw := raw.as_py():
                    held.append(unpacked(raw))
                    size += len(held[-1])
                if size >= HELD:
                    keys, n = merge()
                    held, size = [], 0
                    if len(keys) >= HELD:
                        yield from _partial(keys, n)
                        keys, n = keys[:0], n[:0]
        yield from _partial(*merge())

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        # A name of its own for every try; only files of tries that ended are in the rows that come back.
        name = uuid.uuid4().hex
        first, best = None, {}
        rest_key, rest_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with files.open_output_stream(f"{root}/{name}.keys", compression=None) as key_file, files.open_output_stream(f"{root}/{name}.counts", compression=None) as count_file:

            def put(keys: np.ndarray, n: np.ndarray) -> None:
                nonlocal first
                if not len(keys):
                    return
                first = int(keys[0]) if first is None else first
                key_file.write(keys.tobytes())
                count_file.write(n.tobytes())
                ids = (keys >> np.uint64(SIDE)).astype(np.int64)
                at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                for i, m in zip(ids[at].tolist(), np.maximum.reduceat(n, at).tolist()):
                    best[i] = max(m, best.get(i, 0))

            for b in batches:
                keys, n = summed(np.concatenate([rest_key, b.column(0).to_numpy().astype(np.uint64)]), np.concatenate([rest_n, b.column(1).to_numpy()]))
                put(keys[:-1], n[:-1])
                rest_key, rest_n = keys[-1:], n[-1:]
            put(rest_key, rest_n)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([first], pa.int64()), pa.array([list(best)], pa.list_(pa.int64())), pa.array([list(best.values())], pa.list_(pa.int64()))], names=["path", "first", "ids", "best"])

    partial = materialize(spark, aligned.select("pairs").mapInArrow(count, "key bigint, n bigint"), "pair-partial")
    shards = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(store, "path string, first bigint, ids array<bigint>, best array<bigint>")
    rows = sorted(shards.collect(), key=lambda r: r["first"])
    highest = np.zeros(1 + max((max(r["ids"]) for r in rows), default=0), np.int64)
    for r in rows:
        ids = np.array(r["ids"])
        highest[ids] = np.maximum(highest[ids], r["best"])
    return Counts([r["path"] for r in rows], np.array([r["first"] for r in rows], np.uint64), highest)


def _partial(keys: np.ndarray, n: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), rows):
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + rows].astype(np.int64)), pa.array(n[lo : lo + rows])], names=["key", "n"])


def mapped(path: str, kind: type) -> np.ndarray:
    """A file of numbers, mapped where it lies on a mounted path; else read, and held only while it is used."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return np.memmap(unquote(at.path), kind, "r")
    files, name = arrow_fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(), kind)


def look_up(counts: Counts, keys: np.ndarray) -> np.ndarray:
    """The count of each of some rising keys, shard by shard; 0 for keys that are in none."""
    out = np.zeros(len(keys), np.int64)
    edge = np.append(np.searchsorted(keys, counts.firsts), len(keys))
    for path, lo, hi in zip(counts.paths, edge[:-1], edge[1:]):
        if lo < hi:
            there, n = mapped(f"{path}.keys", np.uint64), mapped(f"{path}.counts", np.int64)
            at = np.minimum(np.searchsorted(there, keys[lo:hi]), len(there) - 1)
            out[lo:hi] = np.where(there[at] == keys[lo:hi], n[at], 0)
    return out


def with_counts(spark: SparkSession, aligned: DataFrame, counts: Counts) -> DataFrame:
    """aligned with n_best and count_sum instead of pairs and times.

    count_sum adds up the counts of all links; n_best is the number of links whose count
    is the highest that their A id has anywhere, ties included.
    """
    ensure_workers(spark)
    kept = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = aligned.select(*kept, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, times = b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist()
            lo = 0
            while lo < len(b):
                keys, links, sizes, hi = [], [], [], lo
                while hi < len(b) and sum(sizes) < LOOKUP:
                    keys.append(unpacked(pairs[hi]) if pairs[hi] else np.zeros(0, np.uint64))
                    links.append(unplaned(times[hi]).astype(np.int64) if times[hi] else np.zeros(0, np.int64))
                    sizes.append(len(keys[-1]))
                    hi += 1
                every = np.concatenate(keys)
                some, place = np.unique(every, return_inverse=True)
                n = look_up(counts, some)[place]
                top = n == counts.highest[(every >> np.uint64(SIDE)).astype(np.int64)]
                ends = np.cumsum(sizes)
                upto = lambda v: np.diff(np.append(0, np.cumsum(v))[np.append(0, ends)])
                weight = np.concatenate(links)
                out = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(out.column(i) for i in range(len(kept))), pa.array(upto(weight * top)), pa.array(upto(weight * n))], names=[*kept, "n_best", "count_sum"])
                lo = hi

    return aligned.select(*kept, "pairs", "times").mapInArrow(run, schema)


def alignment(spark: SparkSession, docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    What encode() says of nulls, empties, repeats and long texts holds; groups_sha256 is
    the SHA-256 of its groups, and '' without tokens. An empty table gives no rows.
    """
    made = encode(spark, docs, byte_path, piece_path, id_col, text_col)
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    aligned = materialize(spark, made.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    done = with_counts(spark, aligned, pair_counts(spark, aligned))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
