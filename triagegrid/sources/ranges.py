"""Records of large JSON documents by byte range, so that one document is many tasks' work.

A range cannot tell by itself whether it begins within a string or how deep. So tasks
first say what their range does to a reader that enters it outside a string, and to
one that enters inside; strung together per file this tells where every range begins.
Then each range gives the records that start in it, and reads on to the last one's end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = 16 << 20
CHUNK = 1 << 20
QUOTE, SLASH = 34, 92


class Piece(NamedTuple):
    """Bytes of JSON text: which lie within strings, by how much each bracket outside them changes the depth, and how the piece ends."""

    inside: np.ndarray
    step: np.ndarray
    ends_inside: bool
    ends_odd: bool


def piece(data: np.ndarray, inside: bool, odd: bool) -> Piece:
    """inside: whether the piece begins within a string; odd: whether an odd number of backslashes stands right before it."""
    n = len(data)
    slash = data == SLASH
    # How many backslashes stand right before each place.
    last = np.maximum.accumulate(np.where(slash, -1, np.arange(n))) if n else np.zeros(0, int)
    run = np.arange(n) - last
    before = np.append(0, run[:-1]) if n else run
    at_start = np.append(-1, last[:-1]) < 0 if n else np.zeros(0, bool)
    escaped = (before + (at_start & odd)) % 2 == 1
    quote = (data == QUOTE) & ~escaped
    after = (np.cumsum(quote) + inside) % 2 == 1
    within = after | quote
    step = np.where(within, 0, ((data == 123) | (data == 91)).astype(np.int64) - ((data == 125) | (data == 93)).astype(np.int64))
    ends_odd = bool((run[-1] + (last[-1] < 0 and odd)) % 2) if n else odd
    return Piece(within, step, bool(after[-1]) if n else inside, ends_odd)


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store that pyarrow opens for an address, and the name there."""
    store, name = arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store, name


def _chunks(f, at: int, size: int | None = None, most: int = CHUNK) -> Iterator[bytes]:
    left = size
    while left is None or left > 0:
        data = f.read(most if left is None else min(most, left))
        if not data:
            return
        left = None if left is None else left - len(data)
        yield data


def _odd_before(f, start: int) -> bool:
    """Whether an odd number of backslashes stands right before a place of a file."""
    n, at = 0, start
    while at > 0:
        size = min(1024, at)
        f.seek(at - size)
        data = f.read(size)
        rest = data.rstrip(b"\\")
        n += len(data) - len(rest)
        if rest:
            break
        at -= size
    return n % 2 == 1


def records_in(chunks: Iterator[bytes], at: int, stop: int | None, inside: bool, odd: bool, depth: int, level: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects that stand in an array at depth `level` and start before stop; chunks begin at place `at`."""
    begun, held = -1, []
    for raw in chunks:
        data = np.frombuffer(raw, np.uint8)
        p = piece(data, inside, odd)
        after = depth + np.cumsum(p.step)
        opens = np.flatnonzero((data == 123) & (p.step == 1) & (after == level + 1))
        closes = np.flatnonzero((data == 125) & (p.step == -1) & (after == level))
        here = 0
        while True:
            if begun < 0:
                i = int(np.searchsorted(opens, here))
                if i == len(opens):
                    break
                here = int(opens[i])
                if stop is not None and at + here >= stop:
                    return
                begun = at + here
            i = int(np.searchsorted(closes, here))
            if i == len(closes):
                held.append(raw[here:])
                break
            end = int(closes[i]) + 1
            yield begun, b"".join([*held, raw[here:end]])
            begun, held, here = -1, [], end
        if begun < 0 and stop is not None and at + len(raw) >= stop:
            return
        inside, odd, depth, at = p.ends_inside, p.ends_odd, int(after[-1]) if len(after) else depth, at + len(raw)


def _packed(path: str) -> bool:
    return path.endswith((".xz", ".gz"))


def _unpacked(path: str, raw) -> object:
    import gzip
    import lzma

    return lzma.open(raw) if path.endswith(".xz") else gzip.open(raw)


def _level(first: bytes) -> int:
    """How deep the array of records is: 1 in a bare list, 2 where the document is an object that holds it."""
    head = first.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
    return 1 if head == b"[" else 2


def read_records(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """(path, item_ord, body): the objects in the documents' arrays of records, body their text, item_ord their first byte's place.

    Documents are bare lists, or objects with the list under some key; objects of other lists
    of the document come back too, so a reader looks for what a record must have. Plain files are read in
    ranges of `split` bytes, which give the same records whatever split is; .gz and
    .xz cannot be entered in the middle and are one task's, record by record.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    packed = F.col("path").rlike(r"\.(xz|gz)$")
    starts = F.when(packed, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("bigint")))
    ranges = files.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.withColumn("stop", F.when(packed, F.lit(None).cast("bigint")).otherwise(F.least(F.col("start") + split, F.col("length"))))
    # A number of tasks is given, as adaptive execution would bring these few bytes, and all reading behind them, into one.
    tasks = 3 * spark.sparkContext.defaultParallelism
    ranges = ranges.repartition(tasks, F.col("path"), F.col("start"))

    def effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, length, start, stop in zip(*(b.column(i).to_pylist() for i in range(4))):
                row = (where, length, start, stop, False, False, 0, 0)
                if stop is not None:
                    store, name = _open(where)
                    with store.open_input_file(name) as f:
                        odd = _odd_before(f, start)
                        f.seek(start)
                        inside, slash, moves = False, odd, [0, 0]
                        for raw in _chunks(f, start, stop - start):
                            data = np.frombuffer(raw, np.uint8)
                            p = piece(data, inside, slash)
                            # Who enters inside a string sees the rest as this one sees strings.
                            q = piece(data, not inside, slash)
                            moves[0] += int(p.step.sum())
                            moves[1] += int(q.step.sum())
                            inside, slash = p.ends_inside, p.ends_odd
                    row = (where, length, start, stop, odd, inside, *moves)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["path", "length", "start", "stop", "odd", "turns", "outside", "within"])

    told = ranges.mapInArrow(effect, "path string, length bigint, start bigint, stop bigint, odd boolean, turns boolean, outside bigint, within bigint")
    # A few numbers per range, in order within each file: whether the reader is in a string, and how deep.
    listed = told.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "odd", "turns", "outside", "within"))).alias("all"))
    first = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("depth"), F.array().cast("array<struct<inside:boolean,depth:bigint>>").alias("seen"))

    def enter(acc, r):
        depth = acc["depth"] + F.when(acc["inside"], r["within"]).otherwise(r["outside"])
        seen = F.array_append(acc["seen"], F.struct(acc["inside"].alias("inside"), acc["depth"].alias("depth")))
        return F.struct((acc["inside"] != r["turns"]).alias("inside"), depth.alias("depth"), seen.alias("seen"))

    places = listed.select("path", F.explode(F.arrays_zip("all", F.aggregate("all", first, enter)["seen"].alias("state"))).alias("z"))
    starts_of = places.select("path", "z.all.start", "z.all.stop", "z.all.odd", F.col("z.state.inside").alias("inside"), F.col("z.state.depth").alias("depth")).repartition(tasks, F.col("path"), F.col("start"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, start, stop, odd, inside, depth in zip(*(b.column(i).to_pylist() for i in range(6))):
                store, name = _open(where)
                with store.open_input_file(name) as raw:
                    if _packed(where):
                        with _unpacked(where, raw) as f:
                            level = _level(f.read(64))
                        raw.seek(0)
                        with _unpacked(where, raw) as f:
                            yield from _rows(where, records_in(_chunks(f, 0), 0, None, False, False, 0, level))
                    else:
                        level = _level(raw.read(64))
                        raw.seek(start)
                        # What is read beyond a small range's last record is small too.
                        yield from _rows(where, records_in(_chunks(raw, start, None, max(4096, min(CHUNK, stop - start))), start, stop, inside, odd, depth, level))

    return starts_of.mapInArrow(find, "path string, item_ord bigint, body string")


def _rows(path: str, found: Iterator[tuple[int, bytes]], most: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string())], names=["path", "item_ord", "body"])

    for at, text in found:
        held.append((at, text.decode("utf-8", "replace")))
        if len(held) >= most:
            yield batch()
            held.clear()
    if held:
        yield batch()
