"""A topic of its own: partitions by key, offsets, and a log of commits, as a Spark data source.

``topic`` is a folder on a file system that all machines share: segments of messages in Parquet, and a log with one entry
for each commit. Writing deals the messages by their keys, each task appends segments of its own, and the commit gives
them their offsets, one entry after the other: the log's next entry can be created once only, so two writers that commit
at the same time take turns. A batch id that is in the log already is not written again. What a failed task or writer
has left is in no entry and never read.

Reading goes by offsets, in batches (``startingOffsets``, ``endingOffsets``) or as a stream, whose place in each
partition is in the stream's checkpoint. Segments are dealt to tasks, and a part of a segment is read by row groups.

Messages of one key are in one partition. There they are in the order of the writer's tasks, within a task in that of its rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from gaugewell.session import ship

FORMAT = "gaugewell_topic"
SCHEMA = "partition int, offset bigint, key string, value string"
PARTITIONS = 8
#: Messages in a row group, the least that a reader skips.
GROUP_ROWS = 1 << 14
#: Messages that a task reads at most, about.
TASK_ROWS = 1 << 20


def local_path(path: str) -> Path:
    """The folder, which must be mounted: the log needs files that can be created once only."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"a topic log needs a folder that all machines have mounted, not {path}")
    return Path(unquote(found.path))


class Log:
    """The commits of a topic, numbered from 0."""

    def __init__(self, root: Path) -> None:
        self.root, self.entries = root, []

    def _file(self, number: int) -> Path:
        return self.root / "log" / f"{number:020d}.json"

    def refresh(self) -> Log:
        while (file := self._file(len(self.entries))).exists():
            self.entries.append(json.loads(file.read_text()))
        return self

    def ends(self) -> dict[int, int]:
        """The next offset of each partition."""
        return {int(p): n for p, n in self.entries[-1]["ends"].items()} if self.entries else {}

    def has(self, batch: str | None) -> bool:
        return batch is not None and any(e["batch"] == batch for e in self.entries)

    def append(self, batch: str | None, segments: list[dict]) -> bool:
        """Commit segments, each a partition, a file and a count, in their order; False if the batch was there."""
        self._file(0).parent.mkdir(parents=True, exist_ok=True)
        while True:
            if self.refresh().has(batch):
                return False
            ends, placed = self.ends(), []
            for segment in segments:
                start = ends.get(segment["partition"], 0)
                ends[segment["partition"]] = start + segment["count"]
                placed.append({**segment, "offset": start})
            draft = self.root / "log" / f".{uuid.uuid4().hex}"
            draft.write_text(json.dumps({"batch": batch, "segments": placed, "ends": ends}))
            try:
                os.link(draft, self._file(len(self.entries)))  # fails if the entry is there; nobody sees half of it
                return True
            except FileExistsError:
                continue
            finally:
                draft.unlink()

    def slices(self, start: dict[int, int], end: dict[int, int]) -> list[Slice]:
        """What is to be read from offset ``start`` on and before ``end``, by partition."""
        found = []
        for entry in self.entries:
            for s in entry["segments"]:
                low = max(start.get(s["partition"], 0), s["offset"])
                high = min(end.get(s["partition"], 0), s["offset"] + s["count"])
                found += [Slice(s["partition"], s["file"], s["offset"], at, min(at + TASK_ROWS, high)) for at in range(low, high, TASK_ROWS)]
        return found


@dataclass
class Slice(InputPartition):
    """The messages ``low`` to ``high - 1`` of a segment that begins at ``offset``."""

    partition: int
    file: str
    offset: int
    low: int
    high: int


def _read(root: Path, part: Slice) -> Iterator[pa.RecordBatch]:
    source, at = pq.ParquetFile(root / "segments" / part.file), part.offset
    for group in range(source.num_row_groups):
        rows = source.metadata.row_group(group).num_rows
        if at + rows > part.low and at < part.high:
            begin = at
            for batch in source.iter_batches(row_groups=[group], columns=["key", "value"]):
                low, high = max(part.low - begin, 0), min(part.high - begin, batch.num_rows)
                if low < high:
                    kept = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part.partition] * kept.num_rows, pa.int32()), pa.array(range(begin + low, begin + high), pa.int64()),
                        kept.column(0).cast(pa.string()), kept.column(1).cast(pa.string())], ["partition", "offset", "key", "value"])
                begin += batch.num_rows
        at += rows


def _offsets(text: str | None, log: Log, default: dict[int, int]) -> dict[int, int]:
    """Offsets given as earliest, latest or a JSON object by partition; partitions that it lacks have the default."""
    if text in (None, ""):
        return default
    if text in ("earliest", "latest"):
        return {} if text == "earliest" else log.ends()
    return {**default, **{int(p): int(n) for p, n in json.loads(text).items()}}


@dataclass
class _Written(WriterCommitMessage):
    task: int
    segments: list[dict]


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.options = local_path(options["path"]), dict(options)

    def partitions(self) -> list[Slice]:
        log = Log(self.root).refresh()
        return log.slices(_offsets(self.options.get("startingoffsets"), log, {}), _offsets(self.options.get("endingoffsets"), log, log.ends()))

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from _read(self.root, partition) if partition is not None else ()


class _StreamReader(DataSourceStreamReader):
    """Offsets in the checkpoint are the next ones by partition."""

    def __init__(self, options) -> None:
        self.root, self.options = local_path(options["path"]), dict(options)
        self.most = int(options.get("maxoffsetspertrigger", 0))
        self.log, self.last = Log(self.root), None

    def initialOffset(self) -> dict:
        return {str(p): n for p, n in _offsets(self.options.get("startingoffsets"), self.log.refresh(), {}).items()}

    def latestOffset(self) -> dict:
        ends = self.log.refresh().ends()
        if self.most and self.last is not None:
            room, ends = self.most, dict(ends)
            for p in sorted(ends):  # as many as are allowed, over the partitions in turn
                taken = min(room, max(0, ends[p] - self.last.get(p, 0)))
                ends[p], room = self.last.get(p, 0) + taken, room - taken
        return {str(p): n for p, n in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        start, end = ({int(p): n for p, n in offsets.items()} for offsets in (start, end))
        self.last = end
        return self.log.refresh().slices(start, end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        yield from _read(self.root, partition)

    def commit(self, end: dict) -> None:
        self.last = {int(p): n for p, n in end.items()}


def _write(root: Path, partitions: int, batches: Iterator[pa.RecordBatch]) -> _Written:
    """A segment for each partition that the task has messages for."""
    (root / "segments").mkdir(parents=True, exist_ok=True)
    task, unkeyed = TaskContext.get().partitionId(), 0
    schema = pa.schema([("key", pa.large_string()), ("value", pa.large_string())])
    writers: dict[int, pq.ParquetWriter] = {}
    files: dict[int, str] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key"))
        rows = pa.table({"key": keys.cast(pa.large_string()), "value": batch.column(batch.schema.get_field_index("value")).cast(pa.large_string())})
        dealt: dict[int, list[int]] = {}
        for row, key in enumerate(keys.to_pylist()):
            if key is None:
                unkeyed += 1
            dealt.setdefault((task + unkeyed if key is None else zlib.crc32(key.encode())) % partitions, []).append(row)
        for p, places in dealt.items():
            if p not in writers:
                files[p] = f"{p}-{uuid.uuid4().hex}.parquet"
                writers[p] = pq.ParquetWriter(root / "segments" / files[p], schema)
            writers[p].write_table(rows.take(pa.array(places)), row_group_size=GROUP_ROWS)
            counts[p] = counts.get(p, 0) + len(places)
    for writer in writers.values():
        writer.close()
    return _Written(task, [{"partition": p, "file": files[p], "count": counts[p]} for p in sorted(files)])


def _segments(messages: list) -> list[dict]:
    return [s for m in sorted((m for m in messages if m is not None), key=lambda m: m.task) for s in m.segments]


def _remove(root: Path, messages: list) -> None:
    for segment in _segments(messages):
        (root / "segments" / segment["file"]).unlink(missing_ok=True)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.root, self.partitions, self.batch = local_path(options["path"]), int(options.get("partitions", PARTITIONS)), options.get("batchid")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _write(self.root, self.partitions, iterator)

    def commit(self, messages: list) -> None:
        if not Log(self.root).append(self.batch, _segments(messages)):
            _remove(self.root, messages)

    def abort(self, messages: list) -> None:
        _remove(self.root, messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    """Each micro-batch is a commit; one that runs again after a failure is not written twice."""

    def __init__(self, options) -> None:
        self.root, self.partitions = local_path(options["path"]), int(options.get("partitions", PARTITIONS))
        self.query = options.get("writer", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _write(self.root, self.partitions, iterator)

    def commit(self, messages: list, batchId: int) -> None:
        if not Log(self.root).append(f"{self.query}-{batchId}", _segments(messages)):
            _remove(self.root, messages)

    def abort(self, messages: list, batchId: int) -> None:
        _remove(self.root, messages)


class TopicSource(DataSource):
    """Options: path, partitions, batchId, writer, startingOffsets, endingOffsets, maxOffsetsPerTrigger."""

    def _lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._lower())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._lower())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._lower())

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self._lower())


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session and its workers."""
    ship(spark).dataSource.register(TopicSource)
    return spark
