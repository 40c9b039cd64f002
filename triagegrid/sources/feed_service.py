"""Feeds asked for over the network: scores of some ids, and a list; all of an answer or none of it."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from triagegrid.session import persisted, shared_path
from triagegrid.sources.ranges import _open

BATCH = 100


def fetch(url: str, timeout: float, tries: int, pause: float) -> dict:
    """The JSON answer of an address, asked up to `tries` times."""
    for turn in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return json.load(r)
        except (OSError, ValueError):
            if turn + 1 == tries:
                raise
            time.sleep(pause * (turn + 1))
    raise ValueError("no tries")


class Batch(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ScoreReader(DataSourceReader):
    """A partition for each file of ids, a request for each partition."""

    def __init__(self, options: dict):
        self.ids, self.url = options["ids"], options["url"]
        self.timeout, self.tries, self.pause = float(options.get("timeout", 10)), int(options.get("tries", 3)), float(options.get("pause", 1))

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as arrow_fs

        store, root = _open(self.ids)
        found = store.get_file_info(arrow_fs.FileSelector(root))
        # File names only: ids stay with the tasks.
        return [Batch(f.path) for f in found if f.is_file and f.base_name.startswith("part-") and f.size > 0] or [Batch("")]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = _open(self.ids)
        with store.open_input_file(partition.path) as f:
            ids = f.read().decode().split()
        told: dict[str, float] = {}
        for lo in range(0, len(ids), BATCH):
            some = ids[lo : lo + BATCH]
            for d in fetch(self.url.replace("{ids}", ",".join(some)), self.timeout, self.tries, self.pause).get("data", []):
                told[d["cve"]] = float(d["epss"])
        # Who asks for an id gets a number; an answer that leaves it out says 0.
        yield from ((i, told.get(i, 0.0)) for i in ids)


class ScoreService(DataSource):
    """spark.read.format("score_service") with options ids (a folder of text files, an id a line), url (with {ids}), timeout, tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "score_service"

    def schema(self) -> str:
        return "cve string, epss double"

    def reader(self, schema) -> ScoreReader:
        return ScoreReader(self.options)


def live_scores(spark: SparkSession, wanted: DataFrame, url: str, timeout: float = 10.0, tries: int = 3, pause: float = 1.0, key: str = "cve") -> DataFrame | None:
    """(cve, epss) of all wanted ids as a service has them now, ids that it leaves out with 0; None if any request fails.

    Ids go to files of BATCH, each of which is a task's request, tried `tries` times.
    """
    spark.dataSource.register(ScoreService)
    folder = shared_path(spark, "wanted-ids")
    wanted.select(key).where(F.col(key).isNotNull()).distinct().write.option("maxRecordsPerFile", BATCH).text(folder)
    try:
        read = spark.read.format("score_service").options(ids=folder, url=url, timeout=str(timeout), tries=str(tries), pause=str(pause)).load()
        return persisted(spark, read, "live-scores")
    except PySparkException:
        return None
    except Exception as e:
        if "Py4JJavaError" in type(e).__name__:
            return None
        raise


def live_listed(spark: SparkSession, urls: list[str], timeout: float = 15.0, tries: int = 1, pause: float = 1.0) -> DataFrame | None:
    """(cve) of the first address that answers with a list; None if none does."""
    for url in urls:
        try:
            ids = [(str(v["cveID"]).strip(),) for v in fetch(url, timeout, tries, pause)["vulnerabilities"]]
            return spark.createDataFrame(ids, "cve string").distinct()
        except (OSError, ValueError, KeyError, TypeError):
            continue
    return None
