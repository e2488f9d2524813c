"""Primary keys that must be unique over all batches of a stream.

How often each key came is kept in the stream's state, which is in its checkpoint: a batch costs what its own
keys cost, and a stream that starts again knows the keys from before. It is a built-in aggregate: every task adds up its
rows by key first, so a key that fills a third of a batch reaches the state as a few rows, and no key runs Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.operators.contract import Contract
from gaugewell.session import configure, path_exists, scratch_path, ship


#: Keeps the state of a task on its disk, so that the keys of a long stream do not have to fit the memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A stream takes these settings when it starts; the session's own are left as they were."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def key_counts(rows: DataFrame, contract: Contract) -> DataFrame:
    """Stream of (key, copies) for the keys of each batch; ``copies`` counts all batches so far."""
    key = F.col("`" + contract.primary_key.replace("`", "``") + "`").cast("string").alias("key")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


@dataclass
class KeyWatch:
    """The folders of a watched stream; one that runs on the same folder goes on where the last one ended."""

    root: str

    @classmethod
    def fresh(cls, spark: SparkSession) -> KeyWatch:
        return cls(scratch_path(spark, "keys"))

    def run(self, rows: DataFrame, contract: Contract, timeout_seconds: float | None = None) -> KeyWatch:
        """Take what the stream holds; the keys that came before, or twice, are stored by batch."""
        ship(configure(rows.sparkSession))

        def store(batch: DataFrame, batch_id: int) -> None:
            batch.where("copies > 1").write.mode("overwrite").parquet(f"{self.root}/repeated/batch-{batch_id}")

        with _state_on_disk(rows.sparkSession):
            query = (
                key_counts(rows, contract).writeStream.outputMode("update").foreachBatch(store)
                .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
            )
        try:
            query.awaitTermination(timeout_seconds)
        finally:
            if query.isActive:
                query.stop()
        return self

    def repeated(self, spark: SparkSession) -> DataFrame:
        """(key, copies, found_in): the keys that came more than once, and the batches in which they were noticed."""
        if not path_exists(spark, f"{self.root}/repeated"):
            return spark.createDataFrame([], "key string, copies long, found_in array<int>")
        batch = F.regexp_extract("_metadata.file_path", r"/batch-(\d+)/", 1).cast("int")
        rows = spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/repeated").select("*", batch.alias("batch"))
        return rows.groupBy("key").agg(F.max("copies").alias("copies"), F.sort_array(F.collect_set("batch")).alias("found_in"))
