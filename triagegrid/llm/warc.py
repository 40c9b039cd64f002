"""WARC archives: a writer with revisit records and a splittable reader of gzip members."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers, shared_dir

REVISIT_MIN = 1000
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20
STEP = 1 << 14
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): refers_to is the response's id for revisits, else null.

    Of rows with equal payloads of REVISIT_MIN bytes or more, the one with the
    largest page_id is the response. Payload bodies are shuffled once, by digest
    and salt; the table they meet has a row for each digest that repeats.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= REVISIT_MIN)
    top = long.groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    top = top.select(F.col("payload_digest").alias("d"), "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    met = rows.join(top, (F.col("payload_digest") == F.col("d")) & (salt == F.col("s")), "left")
    return met.select("page_id", "url", "payload", "payload_digest", F.when(F.col("top") != F.col("page_id"), F.col("top")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has no payload; its digest and length stand in the header."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
        payload = b""
    head += [f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archives(spark: SparkSession, records: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write each partition of plan_records() to one archive in folder, a gzip member per record: rows (path, size).

    A file gets its name when it is whole, from its partition's number, so that a
    task that runs twice leaves one file. folder must be shared; any store that
    pyarrow opens by URI will do.
    """
    ensure_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/{context.partitionId():06d}.warc.gz"
        part = f"{name}.{context.taskAttemptId()}.part"
        some, size = False, 0
        with store.open_output_stream(part, compression=None) as out:
            for b in batches:
                for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    blob = pack.compress(record(*row)) + pack.flush()
                    out.write(blob)
                    size += len(blob)
                    some = True
        if some:
            store.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{context.partitionId():06d}.warc.gz"]), pa.array([size], pa.int64())], names=["path", "size"])
        else:
            store.delete_file(part)

    return records.mapInArrow(run, "path string, size bigint")


class Bytes:
    """A file read forwards in blocks of READ bytes, of which one is held."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.block = f, size, 0, b""

    def at(self, place: int, least: int = 1) -> int:
        """Offset of place in the block, which then holds `least` bytes from there on unless the file ends; past the end the block's length."""
        if not self.base <= place <= self.base + len(self.block) - least:
            if place >= self.size:
                return len(self.block)
            if not (self.base <= place < self.base + len(self.block) and self.base + len(self.block) == self.size):
                self.base, self.block = place, self.f.read_at(min(READ, self.size - place), place)
        return place - self.base

    def find(self, mark: bytes, place: int, stop: int) -> int | None:
        """Where mark first begins in [place, stop)."""
        while place < stop:
            at = self.at(place, len(mark))
            hit = self.block.find(mark, at)
            if hit >= 0:
                return self.base + hit if self.base + hit < stop else None
            if self.base + len(self.block) >= self.size:
                return None
            place = max(place + 1, self.base + len(self.block) - len(mark) + 1)
        return None


def _member(data: Bytes, place: int) -> tuple[bytes, int] | None:
    """The gzip member that begins at place, decompressed, and where it ends; None if it is none or does not begin a WARC record."""
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    try:
        while True:
            at = data.at(place)
            piece = data.block[at : at + STEP]
            if not piece:
                return None
            out.append(unpack.decompress(piece))
            place += len(piece)
            if len(out) == 1 and not out[0].startswith(b"WARC/"[: len(out[0])]):
                return None
            if unpack.eof:
                return b"".join(out), place - len(unpack.unused_data)
    except zlib.error:
        return None


def parse(raw: bytes) -> dict | None:
    """Header fields by lower-case name and b'payload'; None unless the record is whole."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields: dict = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit() or len(body) < int(fields["content-length"]):
        return None
    fields["payload"] = body[: int(fields["content-length"])]
    return fields


def _walk(data: Bytes, start: int, end: int) -> Iterator[tuple[int, int, dict]]:
    """(start, end, fields) of records whose member starts in [start, end): each where the one before ends, or at the next magic bytes that begin one."""
    at = data.find(MAGIC, start, end)
    while at is not None:
        got = _member(data, at)
        found = parse(got[0]) if got else None
        if found is None:
            at = data.find(MAGIC, at + 1, end)
            continue
        yield at, got[1], found
        at = data.find(MAGIC, got[1], end)


def records_in(store, path: str, start: int, end: int, size: int) -> Iterator[dict]:
    """Records whose gzip member starts in [start, end), read from start on."""
    with store.open_input_file(path) as f:
        for _, _, fields in _walk(Bytes(f, size), start, end):
            yield fields


def ways_through(store, path: str, start: int, end: int, size: int) -> dict[int, int]:
    """For each place in [start, end) where a member may start: where the first member at or past end starts, if one starts here.

    A payload may hold members itself, so what looks like one is not always one of
    the archive. Each candidate is followed until it meets the way of another.
    Where nothing starts any more the file's size is told.
    """
    out: dict[int, int] = {}
    with store.open_input_file(path) as f:
        data = Bytes(f, size)
        ahead = Bytes(f, size)
        at = data.find(MAGIC, start, end)
        while at is not None:
            if at not in out:
                way, leads, place = [], None, at
                while leads is None:
                    got = _member(ahead, place)
                    if got is None or parse(got[0]) is None:
                        if not way:
                            break  # no member: nothing starts here
                        after = ahead.find(MAGIC, place + 1, end)
                    else:
                        way.append(place)
                        after = ahead.find(MAGIC, got[1], size)
                    if after is None:
                        leads = size if got else end
                    elif after >= end:
                        leads = after
                    elif after in out:
                        leads = out[after]
                    else:
                        place = after
                for x in way:
                    out[x] = leads
            at = data.find(MAGIC, at + 1, end)
    return out


def true_starts(spark: SparkSession, ranges: DataFrame) -> DataFrame:
    """ranges(path, size, start, end) with start moved to where the first member of the archive in the range starts; ranges without one go.

    Tasks tell the ways through their ranges; per file these are strung together
    from its beginning, a few numbers for each range.
    """

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for path, size, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                store, name = arrow_fs.FileSystem.from_uri(path)
                found = ways_through(store, name, start, end, size)
                # Most members of a range lead to the same place; only others are told one by one.
                most = Counter(found.values()).most_common(1)[0][0] if found else end
                odd = {k: v for k, v in found.items() if v != most}
                made.append((path, size, start, end, most, list(odd), list(odd.values())))
            kinds = [pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=["path", "size", "start", "end", "most", "odd", "leads"])

    def string(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["start"])
        kept, at = [], 0
        for r in rows:
            if at < r["end"]:
                kept.append((r["path"], r["size"], max(at, r["start"]), r["end"]))
                at = max(r["end"], dict(zip(r["odd"], r["leads"])).get(at, r["most"]))
        return pa.table([pa.array([k[i] for k in kept], x) for i, x in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["path", "size", "start", "end"])

    told = ranges.select("path", "size", "start", "end").mapInArrow(ways, "path string, size bigint, start bigint, end bigint, most bigint, odd array<bigint>, leads array<bigint>")
    return told.groupBy("path").applyInArrow(string, "path string, size bigint, start bigint, end bigint")


def read_archives(spark: SparkSession, files: DataFrame, split: int = 16 << 20) -> DataFrame:
    """Records of the archives in files(path, size), in byte ranges of about split bytes, dealt over tasks.

    Twice over the bytes: first tasks find what may start a record by scanning
    their ranges for gzip magic and decoding headers, and from that follows where
    the first record of each range starts; then each range reads the records that
    start inside it.

    (page_id, url, record_type, refers_to, payload, payload_digest, payload_bytes).
    Of a response the digest and length are those of the payload that was read;
    of a revisit those its header states. Bytes that look like a member and do
    not decode to a whole WARC record are passed over.
    """
    ensure_workers(spark)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("bigint"))
    ranges = files.where("size > 0").select("path", "size", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + split, F.col("size")))
    width = 4 * spark.sparkContext.defaultParallelism
    tasks = max(width, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = true_starts(spark, ranges.repartition(tasks, "path", "start")).repartition(tasks, "path", "start")
    ddl = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_digest string, payload_bytes bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start, end in zip(*(b.column(i).to_pylist() for i in range(4))):
                store, name = arrow_fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                for r in records_in(store, name, start, end, size):
                    whole = r["warc-type"] != "revisit"
                    payload = r["payload"]
                    rows.append((
                        int(r["x-page-id"]) if r.get("x-page-id") else None,
                        r.get("warc-target-uri"),
                        r["warc-type"],
                        int(r["x-refers-to-page-id"]) if r.get("x-refers-to-page-id") else None,
                        payload if whole else None,
                        hashlib.sha1(payload).hexdigest() if whole else r["warc-payload-digest"].removeprefix("sha1:"),
                        len(payload) if whole else int(r["x-payload-length"]),
                    ))
                    held += len(payload)
                    if held > 8 * READ or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, ddl)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, split: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write pages to WARC archives, then read them back: what read_archives() returns, one row per page.

    Null html is an empty payload; rows that repeat a page_id are written again,
    and do not revisit themselves; a null page_id never wins over another. An
    empty table writes no archive and returns no rows. Columns other than the three
    are not read.
    """
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(spark, plan_records(pages, id_col, url_col, body_col), folder)
    # The archives are written now, once; their names and sizes are a row for each partition.
    listed = spark.createDataFrame(files.collect(), "path string, size bigint")
    return read_archives(spark, listed, split)
