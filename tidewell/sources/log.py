"""A message log on Parquet files: partitions, offsets, and a stream reader for them.

A log folder has segments (files of one partition, in the order of their
offsets) and an index whose numbered files name the segments of each append.
The reader plans offsets on the driver, from the index alone; segments are read
by tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewell.sources.tables import TRIES, Taken, _Folder

FORMAT = "tidewell_log"
MESSAGE = "key string, value string, partition int, offset long"
#: Bytes of a row group of a segment.
ROW_GROUP = 1 << 20
#: Messages that a task reads at least before a segment is cut for another, and cuts of a trigger at most.
STRETCH, STRETCHES = 8192, 256


def _ends(segments: list[dict]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in segments:
        out[s["partition"]] = max(out.get(s["partition"], 0), s["base"] + s["rows"])
    return out


def _segments(folder: _Folder) -> list[dict]:
    return [s for name in folder.names("index") if name.endswith(".json") for s in json.loads(folder.read(f"index/{name}"))["segments"]]


def append_log(df: DataFrame, path: str, *, partitions: int = 8, order: Sequence[str] = (), tasks: int | None = None) -> None:
    """Appends rows with key and value to the log at path.

    A key's rows go to one partition, in the `order` of columns of df; offsets
    go on without gaps. A partition is written by many tasks, each one
    segment, so a common key is no single task. Appends at the same time each
    in turn get their offsets. Readers see an append whole or not at all. An
    empty df appends nothing.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path)
    number = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(partitions)), F.lit(0)).cast("int")
    rows = df.withColumn("__partition", number).repartitionByRange(tasks or partitions, "__partition", *order)
    rows = rows.sortWithinPartitions("__partition", *order).select("key", "value", "__partition")
    at = f"segments/{uuid.uuid4().hex}"
    # Row groups are small, so that a trigger can begin in the middle of a segment without reading what lies before.
    rows.write.partitionBy("__partition").option("parquet.block.size", ROW_GROUP).parquet(f"{folder.path}/{at}")
    files = []
    if any(n.startswith("__partition=") for n in folder.names(at)):
        found = spark.read.parquet(f"{folder.path}/{at}").groupBy("__partition", F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
        # One row for each file; names of a job's files rise with the sorted ranges.
        files = sorted((int(r["__partition"]), r.file.rpartition("/")[2], r.n) for r in found.collect())
    if not files:
        return
    for _ in range(TRIES):
        name = f"{len([n for n in folder.names('index') if n.endswith('.json')]):010d}"
        ends = _ends(_segments(folder))
        made = []
        for p, file, n in files:
            made.append({"partition": p, "base": ends.get(p, 0), "rows": n, "path": f"{at}/__partition={p}/{file}"})
            ends[p] = ends.get(p, 0) + n
        try:
            return folder.put(f"index/{name}.json", json.dumps({"segments": made}))
        except Taken:
            continue
    raise RuntimeError(f"{path}: other writers were faster {TRIES} times")


class _Segment(InputPartition):
    def __init__(self, path: str, partition: int, base: int, low: int, high: int):
        self.path, self.partition, self.base, self.low, self.high = path, partition, base, low, high


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


class LogReader(DataSourceStreamReader):
    """Offsets are {partition: next offset}; a trigger takes at most `maxOffsetsPerTrigger` messages, dealt by what waits in each partition.

    Spark tells the reader where a query stands by planning (an empty stretch,
    after a restart), so latestOffset() goes on from there.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        limit = options.get("maxoffsetspertrigger")
        self.limit = int(limit) if limit else None
        self.start = options.get("startingoffsets", "earliest")
        if self.start not in ("earliest", "latest"):
            raise ValueError(f"startingOffsets is earliest or latest, not {self.start}")
        self.at: dict[str, int] = {}
        self.read_index: dict[str, list[dict]] = {}

    def _known(self) -> list[dict]:
        fs, path = _opened(f"{self.path}/index")
        for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if info.path.endswith(".json") and info.base_name not in self.read_index:
                with fs.open_input_stream(info.path) as f:
                    self.read_index[info.base_name] = json.loads(f.read())["segments"]
        return [s for name in sorted(self.read_index) for s in self.read_index[name]]

    def initialOffset(self) -> dict:
        self.at = {str(p): e for p, e in _ends(self._known()).items()} if self.start == "latest" else {}
        return self.at

    def latestOffset(self) -> dict:
        ends = _ends(self._known())
        waiting = {str(p): e - self.at.get(str(p), 0) for p, e in ends.items()}
        total = sum(waiting.values())
        if self.limit is None or total <= self.limit:
            take = waiting
        else:
            take = {p: n * self.limit // total for p, n in waiting.items()}
            for p in sorted(waiting, key=lambda p: (take[p] - waiting[p] * self.limit / total, p))[: self.limit - sum(take.values())]:
                take[p] += 1
        self.at = self.at | {p: self.at.get(p, 0) + n for p, n in take.items()}
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Stretches of segments between the offsets, long ones cut so that several tasks read them."""
        self.at = dict(end)
        found = []
        for s in self._known():
            low, high = (max(o.get(str(s["partition"]), 0), s["base"]) if o is start else min(o.get(str(s["partition"]), 0), s["base"] + s["rows"]) for o in (start, end))
            if low < high:
                found.append((s, low, high))
        most = max(STRETCH, sum(high - low for _, low, high in found) // STRETCHES)
        cut = [(s, at, min(at + most, high)) for s, low, high in found for at in range(low, high, most)]
        return [_Segment(f"{self.path}/{s['path']}", s["partition"], s["base"], low, high) for s, low, high in cut]

    def read(self, segment: _Segment) -> Iterator[pa.RecordBatch]:
        """Messages of the stretch; row groups that lie outside it are not read."""
        fs, path = _opened(segment.path)
        with fs.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            at, within = segment.base, []
            for k in range(file.num_row_groups):
                n = file.metadata.row_group(k).num_rows
                if at + n > segment.low and at < segment.high:
                    if not within:
                        where = at
                    within.append(k)
                at += n
            for batch in file.iter_batches(row_groups=within, columns=["key", "value"]) if within else ():
                low, high = max(segment.low - where, 0), min(segment.high - where, len(batch))
                if low < high:
                    offsets = pa.array(range(where + low, where + high), pa.int64())
                    columns = [*batch.slice(low, high - low).select(["key", "value"]).columns, pa.array([segment.partition] * (high - low), pa.int32()), offsets]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "value", "partition", "offset"])
                where += len(batch)
                if where >= segment.high:
                    break


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def read_log_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of messages (key, value, partition, offset) of the log at path.

    Options as of the message broker's reader: startingOffsets (earliest or
    latest), maxOffsetsPerTrigger.
    """
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).options(**options).load(path)
