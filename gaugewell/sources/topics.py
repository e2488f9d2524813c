"""Topics: where payload messages are sent to and read from.

``KafkaTopic`` needs the Spark Kafka connector on the cluster. ``LogTopic`` has partitions, offsets and
commits of its own in a shared folder and needs no broker. ``FileTopic`` keeps the messages as plain files.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gaugewell.session import path_exists
from gaugewell.sources import topic_log

MESSAGE_SCHEMA = "key string, value string"


@dataclass
class KafkaTopic:
    name: str
    servers: str | list[str] = "localhost:9092"
    starting_offsets: str = "earliest"
    max_offsets_per_batch: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    @property
    def bootstrap(self) -> str:
        return self.servers if isinstance(self.servers, str) else ",".join(self.servers)

    def source_options(self) -> dict[str, str]:
        found = {
            "kafka.bootstrap.servers": self.bootstrap,
            "subscribe": self.name,
            "startingOffsets": self.starting_offsets,
        }
        if self.max_offsets_per_batch:
            found["maxOffsetsPerTrigger"] = str(self.max_offsets_per_batch)
        return {**found, **self.options}

    def sink_options(self) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.bootstrap,
            "topic": self.name,
            "kafka.compression.type": "snappy",
            "kafka.acks": "all",
            "kafka.retries": "3",
            "kafka.retry.backoff.ms": "100",
            **self.options,
        }

    def read_stream(self, spark: SparkSession) -> DataFrame:
        stream = spark.readStream.format("kafka").options(**self.source_options()).load()
        return stream.selectExpr("cast(key as string) as key", "cast(value as string) as value")

    def write(self, messages: DataFrame) -> None:
        messages.write.format("kafka").options(**self.sink_options()).save()


@dataclass
class FileTopic:
    path: str
    max_files_per_batch: int | None = None

    @property
    def name(self) -> str:
        return self.path

    def read_stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.schema(MESSAGE_SCHEMA).option("recursiveFileLookup", True)
        if self.max_files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_batch)
        return reader.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MESSAGE_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)

    def write(self, messages: DataFrame, batch_id: str | None = None) -> None:
        """Append messages; those of a batch id that was written whole before are left out."""
        if batch_id is None:
            messages.write.mode("append").parquet(self.path)
            return
        folder = f"{self.path.rstrip('/')}/{hashlib.sha256(batch_id.encode()).hexdigest()[:24]}"
        if not path_exists(messages.sparkSession, f"{folder}/_SUCCESS"):
            messages.write.mode("overwrite").parquet(folder)


@dataclass
class LogTopic:
    """A topic in a folder that all machines have mounted."""

    path: str
    partitions: int = topic_log.PARTITIONS
    starting_offsets: str | dict[int, int] = "earliest"
    max_offsets_per_batch: int | None = None

    @property
    def name(self) -> str:
        return self.path

    def read_stream(self, spark: SparkSession) -> DataFrame:
        """(key, value) of all messages from the starting offsets on; the checkpoint knows what is done."""
        reader = topic_log.register(spark).readStream.format(topic_log.FORMAT).option("path", self.path)
        reader = reader.option("startingOffsets", _offsets(self.starting_offsets))
        if self.max_offsets_per_batch:
            reader = reader.option("maxOffsetsPerTrigger", self.max_offsets_per_batch)
        return reader.load().select("key", "value")

    def read(self, spark: SparkSession, start: str | dict[int, int] | None = None, end: str | dict[int, int] = "latest") -> DataFrame:
        """(partition, offset, key, value) from ``start`` on and before ``end``: offsets by partition, earliest or latest."""
        reader = topic_log.register(spark).read.format(topic_log.FORMAT).option("path", self.path)
        start = self.starting_offsets if start is None else start
        return reader.option("startingOffsets", _offsets(start)).option("endingOffsets", _offsets(end)).load()

    def write(self, messages: DataFrame, batch_id: str | None = None) -> None:
        """Append messages in one commit; a batch id that was written before is left out."""
        topic_log.register(messages.sparkSession)
        writer = messages.select("key", "value").write.format(topic_log.FORMAT)
        writer = writer.option("path", self.path).option("partitions", self.partitions)
        if batch_id is not None:
            writer = writer.option("batchId", batch_id)
        writer.mode("append").save()

    def end_offsets(self) -> dict[int, int]:
        """The next offset of each partition."""
        return topic_log.Log(topic_log.local_path(self.path)).refresh().ends()


def _offsets(offsets: str | dict[int, int]) -> str:
    return offsets if isinstance(offsets, str) else json.dumps({str(p): n for p, n in offsets.items()})
