"""Bounded stream ingestion: learn once, freeze, validate every micro-batch."""

from __future__ import annotations

import logging
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugewell.functions.quality import QUALITY_LEVELS
from gaugewell.operators.profile import TableProfile, learn_profile
from gaugewell.operators.report import statistics_columns, success_rate
from gaugewell.session import configure, path_exists, remove_path, scratch_path
from gaugewell.streaming.payload import (
    is_payload,
    malformed,
    payload_table,
    validate_payloads,
    well_formed,
)

logger = logging.getLogger(__name__)


@dataclass
class Ingestion:
    """The folders of one ingestion; a new one replays the topic from its start."""

    root: str

    @classmethod
    def fresh(cls, spark: SparkSession) -> Ingestion:
        return cls(scratch_path(spark, "ingestion"))

    @property
    def validated_path(self) -> str:
        return f"{self.root}/validated"

    @property
    def rejected_path(self) -> str:
        return f"{self.root}/rejected"

    @property
    def profile_path(self) -> str:
        return f"{self.root}/profile"

    @property
    def checkpoint_path(self) -> str:
        return f"{self.root}/checkpoint"

    def validated(self, spark: SparkSession) -> DataFrame | None:
        """All validated rows so far; None before the first batch."""
        if not path_exists(spark, self.validated_path):
            return None
        return _stored(spark, self.validated_path)

    def rejected(self, spark: SparkSession) -> DataFrame | None:
        if not path_exists(spark, self.rejected_path):
            return None
        return _stored(spark, self.rejected_path)

    def profile(self, spark: SparkSession) -> TableProfile | None:
        if not path_exists(spark, self.profile_path):
            return None
        return TableProfile.load(spark, self.profile_path)

    @property
    def totals_path(self) -> str:
        return f"{self.root}/totals"

    def _batches(self, spark: SparkSession) -> list[int]:
        """The batches whose totals are kept, ascending."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.totals_path)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))

    def totals(self, spark: SparkSession, before: int | None = None) -> Row | None:
        """The counters over all batches so far, or over those before a batch: one stored row."""
        known = [b for b in self._batches(spark) if before is None or b < before]
        return _stored(spark, _batch_path(self.totals_path, known[-1])).first() if known else None

    def _save_totals(self, spark: SparkSession, batch_id: int, before: Row | None, seen: dict[str, int]) -> None:
        """Counters up to this batch. A batch that runs again writes the same row; older rows than the last two go."""
        total = {name: n + (before[name] if before else 0) for name, n in seen.items()}
        row = spark.createDataFrame([tuple(total.values())], ", ".join(f"{name} bigint" for name in total))
        row.coalesce(1).write.mode("overwrite").parquet(_batch_path(self.totals_path, batch_id))
        for old in self._batches(spark)[:-2]:
            remove_path(spark, _batch_path(self.totals_path, old))

    def statistics(self, spark: SparkSession) -> DataFrame | None:
        """Running statistics; may be asked for while the stream runs. They come from the kept counters, no row is read again."""
        known = self._batches(spark)
        if not known:
            return None
        rate = success_rate(F.col("valid_records"), F.col("total_records"))
        return _stored(spark, _batch_path(self.totals_path, known[-1])).withColumn("success_rate", rate)


#: Rows of a task that are looked at together to find the last one taken.
_BLOCK_BITS = 12


def up_to_record(messages: DataFrame, most: int) -> DataFrame:
    """The messages up to the ``most``-th well-formed one, task by task; all of them if there are fewer.

    Well-formed messages are counted per task, and only within the task that holds the last one its place is looked
    up, by counts of blocks and then in one block. What is kept is then a range of places: a filter in every task.
    """
    placed = messages.withColumn("__place", F.monotonically_increasing_id())
    good = placed.where(is_payload(F.col("value")))

    def falls_in(group: str, rows: DataFrame, wanted: int) -> tuple[int, int] | None:
        """The group with the wanted row, and that row's number in it."""
        counts = rows.groupBy(F.shiftright("__place", group).alias("part")).count().orderBy("part").collect()
        for row in counts:
            if wanted <= row["count"]:
                return row["part"], wanted
            wanted -= row["count"]
        return None

    if most <= 0:
        return placed.where("false").drop("__place")
    task = falls_in(33, good, most)  # a row for each task
    if task is None:
        return placed.drop("__place")
    inside = good.where(F.shiftright("__place", 33) == task[0])
    block, number = falls_in(_BLOCK_BITS, inside, task[1])
    places = inside.where(F.shiftright("__place", _BLOCK_BITS) == block).select("__place").collect()  # of one block
    last = sorted(r["__place"] for r in places)[number - 1]
    return placed.where(F.col("__place") <= last).drop("__place")


def _batch_path(path: str, batch_id: int) -> str:
    # no partition folder: its column could meet a field of the messages
    return f"{path}/batch-{batch_id}"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def start(
    messages: DataFrame,
    ingestion: Ingestion,
    profile: TableProfile | None = None,
    max_records: int | None = None,
    source_file: str = "kafka_stream",
    skip_failed_batches: bool = False,
) -> StreamingQuery:
    """Start validating a stream of (key, value) messages until what is there is read.

    The profile is learned on the first batch unless given, stored, and applied as literals to all later
    batches. Each batch overwrites its own folder, so a batch that runs again after a failure leaves no
    duplicates, and stores the counters of all batches so far. With ``max_records`` the stream stops when that
    many well-formed messages were taken: what is behind the last of them, malformed messages too, is not
    read by later batches.
    """
    spark = configure(messages.sparkSession)
    frozen, full = {"profile": profile}, threading.Event()
    counters = ["total_records", "valid_records", "invalid_records", *(f"{level}_quality" for level in QUALITY_LEVELS)]

    def learned(batch: DataFrame) -> TableProfile:
        found = frozen["profile"]
        if found is None:
            found = ingestion.profile(spark)
        if found is None:
            found = learn_profile(payload_table(batch))
        if not path_exists(spark, ingestion.profile_path):
            found.save(spark, ingestion.profile_path)
        frozen["profile"] = found
        return found

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = ingestion.totals(spark, before=batch_id)
        batch = batch.select("key", "value")
        if max_records is not None:
            room = max_records - (before["total_records"] if before else 0)
            if room <= 0:
                full.set()
                return
            batch = up_to_record(batch, room)
        malformed(batch).write.mode("overwrite").parquet(_batch_path(ingestion.rejected_path, batch_id))
        batch = well_formed(batch)
        seen = {name: 0 for name in counters}
        if not batch.isEmpty():
            found = Observation(f"batch {batch_id}")
            rows = validate_payloads(batch, learned(batch), source_file).observe(found, *statistics_columns())
            rows.write.mode("overwrite").parquet(_batch_path(ingestion.validated_path, batch_id))
            seen = {name: found.get[name] for name in counters}
        ingestion._save_totals(spark, batch_id, before, seen)
        if max_records is not None and seen["total_records"] + (before["total_records"] if before else 0) >= max_records:
            full.set()

    def guarded(batch: DataFrame, batch_id: int) -> None:
        try:
            handle(batch, batch_id)
        except Exception:
            logger.exception("Batch %d failed and is skipped", batch_id)

    query = (
        messages.writeStream.foreachBatch(guarded if skip_failed_batches else handle)
        .option("checkpointLocation", ingestion.checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    if max_records is not None:
        threading.Thread(target=_stop_when, args=(query, full), daemon=True).start()
    return query


def _stop_when(query: StreamingQuery, full: threading.Event) -> None:
    """End a stream from outside of its batches, as soon as it has what it may take."""
    while query.isActive:
        if full.wait(0.1):
            query.stop()
            return


def run(
    messages: DataFrame,
    ingestion: Ingestion,
    timeout_seconds: float | None = None,
    **options,
) -> Ingestion:
    """Ingest what the topic holds, for at most ``timeout_seconds``."""
    query = start(messages, ingestion, **options)
    try:
        finished = query.awaitTermination(timeout_seconds)
        if timeout_seconds is not None and not finished:
            logger.info("Timeout reached (%ss)", timeout_seconds)
    finally:
        if query.isActive:
            query.stop()
    return ingestion
