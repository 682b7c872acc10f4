"""A topic as a partitioned log of files, as a data source with stream reader and stream writer.

It has what a detector needs of a broker: keyed partitions, an offset for every message, and readers that keep their own
place.  A topic is a folder with one folder per partition; a segment is a file of messages, one JSON object per line, named
`<first offset>-<number of messages>-<batch>`.  Segments are never changed, so any reader can be replayed from any offset.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage,
)
from pyspark.sql.streaming import DataStreamWriter

from borewatch.sources.named_files import filesystem

FORMAT = "topic_log"
SCHEMA = "partition INT, offset BIGINT, key STRING, value STRING"
PARTITIONS = 8


@dataclass(frozen=True)
class Segment:
    partition: int
    first: int
    count: int
    batch: str
    path: str


def segments(path: str) -> list[Segment]:
    """Every segment of a topic, by partition and offset."""
    files, root = filesystem(path)
    found = []
    for info in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder = posixpath.basename(posixpath.dirname(info.path))
        if info.type == pafs.FileType.File and folder.startswith("p") and folder[1:].isdigit():
            first, count, batch = info.base_name.split("-", 2)
            found.append(Segment(int(folder[1:]), int(first), int(count), batch, info.path))
    return sorted(found, key=lambda s: (s.partition, s.first))


def ends(path: str) -> dict[str, int]:
    """Offset behind the last message of each partition."""
    found: dict[str, int] = {}
    for s in segments(path):
        found[str(s.partition)] = max(found.get(str(s.partition), 0), s.first + s.count)
    return found


@dataclass
class Slice(InputPartition):
    """Messages `begin` to `end` of a segment."""

    path: str
    partition: int
    first: int
    begin: int
    end: int


class TopicReader(DataSourceStreamReader):
    """Offsets are a map from partition to the next message; they live in the checkpoint of the query."""

    def __init__(self, path: str, starting: str):
        self.path, self.starting = path, starting

    def initialOffset(self) -> dict:
        return ends(self.path) if self.starting == "latest" else {}

    def latestOffset(self) -> dict:
        return ends(self.path)

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        out = []
        for s in segments(self.path):
            begin, stop = start.get(str(s.partition), 0), end.get(str(s.partition), 0)
            begin, stop = max(begin, s.first), min(stop, s.first + s.count)
            if begin < stop:
                out.append(Slice(s.path, s.partition, s.first, begin, stop))
        return out

    def read(self, partition: Slice) -> Iterator[tuple]:
        files, _ = filesystem(self.path)
        with files.open_input_stream(partition.path) as source:
            for at, line in enumerate(_lines(source), partition.first):
                if at >= partition.end:
                    break
                if at >= partition.begin:
                    message = json.loads(line)
                    yield partition.partition, at, message.get("key"), message.get("value")

    def commit(self, end: dict) -> None:
        """Segments stay: other readers have places of their own."""


def _lines(source) -> Iterator[bytes]:
    held = b""
    while block := source.read(1 << 20):
        *whole, held = (held + block).split(b"\n")
        yield from whole
    if held:
        yield held


@dataclass
class Landed(WriterCommitMessage):
    attempt: str
    counts: dict[int, int]


class _Writer:
    """Tasks write one file per partition of the topic; the commit step gives them their offsets by moving them."""

    def __init__(self, path: str, partitions: int, stream: str):
        self.path, self.count, self.stream = path, partitions, stream

    def write(self, iterator: Iterator[Row]) -> Landed:
        files, root = filesystem(self.path)
        attempt = posixpath.join(root, "_attempts", uuid.uuid4().hex)
        outs, counts = {}, defaultdict(int)
        for row in iterator:
            place = zlib.crc32(row["key"].encode()) % self.count if row["key"] is not None else 0
            if place not in outs:
                files.create_dir(attempt, recursive=True)
                outs[place] = files.open_output_stream(posixpath.join(attempt, str(place)))
            outs[place].write(json.dumps({"key": row["key"], "value": row["value"]}).encode() + b"\n")
            counts[place] += 1
        for out in outs.values():
            out.close()
        return Landed(attempt, dict(counts))

    def land(self, messages: list[Landed | None], batch: str) -> None:
        """A partition that already holds the batch is left alone: the batch was cut off and runs again."""
        files, root = filesystem(self.path)
        name = f"{self.stream}-{batch}"
        there = {s.partition for s in segments(self.path) if s.batch.rsplit("-", 1)[0] == name}
        last = ends(self.path)
        for task, message in enumerate(m for m in messages if m is not None):
            for place, count in sorted(message.counts.items()):
                if place in there:
                    continue
                first = last.get(str(place), 0)
                files.create_dir(posixpath.join(root, f"p{place}"), recursive=True)
                files.move(
                    posixpath.join(message.attempt, str(place)),
                    posixpath.join(root, f"p{place}", f"{first:020d}-{count}-{name}-{task}"),
                )
                last[str(place)] = first + count
        self.drop(messages)

    def drop(self, messages: list[Landed | None]) -> None:
        files, _ = filesystem(self.path)
        for message in messages:
            if message is not None and message.counts:
                files.delete_dir(message.attempt)


class TopicStreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self.land(messages, str(batchId))

    def abort(self, messages, batchId: int) -> None:
        self.drop(messages)


class TopicWriter(_Writer, DataSourceWriter):
    def commit(self, messages) -> None:
        self.land(messages, uuid.uuid4().hex)

    def abort(self, messages) -> None:
        self.drop(messages)


class TopicLog(DataSource):
    """Options: path; startingOffsets (earliest or latest); partitions; stream, a name for what a query writes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TopicReader:
        return TopicReader(self.options["path"], self.options.get("startingOffsets", "earliest"))

    def _partitions(self) -> int:
        return int(self.options.get("partitions", PARTITIONS))

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(self.options["path"], self._partitions(), self.options["stream"])

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options["path"], self._partitions(), "batch")


def read_log(spark: SparkSession, path: str, starting: str = "earliest") -> DataFrame:
    """A topic as a stream of (partition, offset, key, value)."""
    spark.dataSource.register(TopicLog)
    return spark.readStream.format(FORMAT).option("path", path).option("startingOffsets", starting).load()


def send_to_log(df: DataFrame, path: str, partitions: int = PARTITIONS) -> None:
    """Rows (key, value) to a topic; messages of a key keep the order they have in their partition."""
    df.sparkSession.dataSource.register(TopicLog)
    df.select("key", "value").write.format(FORMAT).mode("append").option("path", path).option("partitions", partitions).save()


def stream_to_log(stream: DataFrame, path: str, checkpoint: str, name: str, partitions: int = PARTITIONS) -> DataStreamWriter:
    """A stream of (key, value) to a topic; `name` tells its batches from those of other queries on the topic."""
    stream.sparkSession.dataSource.register(TopicLog)
    return (
        stream.select("key", "value").writeStream.format(FORMAT).option("path", path).option("partitions", partitions)
        .option("stream", name).option("checkpointLocation", checkpoint)
    )
