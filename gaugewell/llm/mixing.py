"""Sources interleaved to target weights by proportionate-fair scheduling of blocks.

Each source is cut into blocks of equally many documents, in an order drawn by a hash.
Shares are whole numbers, so the schedule repeats: in one cycle of M slots a source with m
blocks gives its k-th block the release time floor(k M / m) and the deadline
ceil((k + 1) M / m), and the earliest deadline among the released blocks goes next. Every
prefix then holds each source to within less than one block of its weight. When a source
runs out, its last cycle and the cycles after it are scheduled anew for what is left, so every
document is placed exactly once and none is repeated or left out.

Cycles between two changes are alike and share one pattern, which a task computes; together the patterns
have no more entries than there are blocks. Where they are few, tasks get them whole; else, and where there are many
sources, they stay a table that documents are joined with. The driver knows the cycles at which something changes, at most
two numbers a source. Documents find their place by their number within the source, which comes from counts per bounded
group and their running sums, so a source of any size is spread over many tasks.

Cases: a null source is a source of its own; sources without a share get the default share;
repeated rows are placed one after another; an empty table stays empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.session import remove_path, scratch_path, ship

BLOCK_DOCUMENTS = 16
#: Documents that one task numbers together, about.
GROUP_DOCUMENTS = 4096
#: Sources, and entries of patterns, up to which every task gets all of them; beyond, they are joined. Results are the same.
SHIPPED_SOURCES = 5_000
SHIPPED_ENTRIES = 1_000_000
PLACES = ("mix_block", "mix_position", "mix_release", "mix_deadline")


def cycle(blocks: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, its k, slot, release, deadline) of one cycle in which source i has ``blocks[i]`` blocks."""
    slots = sum(blocks)
    arrivals = sorted((k * slots // m, -(-(k + 1) * slots // m), i, k) for i, m in enumerate(blocks) for k in range(m))
    waiting: list[tuple[int, int, int, int]] = []
    out, at = [], 0
    for slot in range(slots):
        while at < len(arrivals) and arrivals[at][0] <= slot:
            release, deadline, i, k = arrivals[at]
            heapq.heappush(waiting, (deadline, i, k, release))
            at += 1
        deadline, i, k, release = heapq.heappop(waiting)
        out.append((i, k, slot, release, deadline))
    return out


def _changes(blocks: DataFrame) -> tuple[np.ndarray, int]:
    """The cycles at which the blocks per cycle change, ascending from 0, and the number of cycles."""
    cycles = F.floor(F.col("blocks") / F.col("share")).cast("long")
    longest = blocks.agg(F.max(F.ceil(F.col("blocks") / F.col("share")))).first()[0] or 0
    # a source starts its last, short cycle, and is gone behind it
    found = blocks.select(F.explode(F.array(F.lit(0).cast("long"), cycles, cycles + 1)).alias("c")).distinct()
    return np.array(sorted(r["c"] for r in found.where(F.col("c") < max(int(longest), 1)).collect()), np.int64), int(longest)


def _active(first: np.ndarray):
    """(segment, source, blocks in a cycle of the segment) for each source and the segments that it reaches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, blocks, share in zip(*(batch.column(i).to_pylist() for i in range(3))):
                inside = np.clip(blocks - first * share, 0, share)
                there = np.flatnonzero(inside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there), pa.array([source] * len(there), pa.int64()), pa.array(inside[there])], ["segment", "source", "inside"])
    return run


def _pattern(rows: pa.Table) -> pa.Table:
    order = np.argsort(rows.column("source").to_numpy(), kind="stable")
    source, inside = (rows.column(c).to_numpy()[order] for c in ("source", "inside"))
    i, k, slot, release, deadline = np.array(cycle(inside.tolist()), np.int64).reshape(-1, 5).T
    return pa.table({"segment": np.full(len(i), rows.column("segment")[0].as_py()), "source": source[i], "k": k, "slot": slot,
                     "release": release, "deadline": deadline})


_PATTERN = "segment long, source long, k long, slot long, release long, deadline long"


class Segments:
    """Where the cycles of equal pattern begin, in cycles and in slots of the whole mix."""

    def __init__(self, first: np.ndarray, slots: np.ndarray, longest: int) -> None:
        self.first, self.slots = first, slots
        self.base = np.concatenate([[0], np.cumsum(np.diff(np.append(first, longest)) * slots)[:-1]]).astype(np.int64)

    def find(self, cycles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segment of each cycle, and the slot at which the cycle starts."""
        segment = np.searchsorted(self.first, cycles, "right") - 1
        return segment, self.base[segment] + (cycles - self.first[segment]) * self.slots[segment]


def _with_slots(segments: Segments, block_documents: int, patterns: np.ndarray | None):
    """Segment, k and start of the cycle for each document; with ``patterns`` at hand also its place."""
    if patterns is not None:
        order = np.lexsort((patterns[2], patterns[1], patterns[0]))
        patterns = patterns[:, order]
        width = np.int64(patterns[2].max(initial=0) + 1)
        sources = np.int64(patterns[1].max(initial=0) + 1)
        entry = (patterns[0] * sources + patterns[1]) * width + patterns[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, share, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__source", "__share", "__number"))
            block = number // block_documents
            segment, start = segments.find(block // share)
            if patterns is None:
                more = {"__segment": segment, "__k": block % share, "__start": start}
            else:
                at = np.searchsorted(entry, (segment * sources + source) * width + block % share)
                more = {f"__{c}": start + patterns[row][at] for c, row in (("slot", 3), ("release", 4), ("deadline", 5))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64()) for v in more.values())], [*batch.schema.names, *more])
    return run


def mix_sources(
    docs: DataFrame, shares: Mapping[str | None, int] | None = None, default_share: int = 1,
    block_documents: int = BLOCK_DOCUMENTS, id_col: str = "doc_id", source_col: str = "source",
    shipped_sources: int = SHIPPED_SOURCES, shipped_entries: int = SHIPPED_ENTRIES,
) -> DataFrame:
    """The documents with their place: mix_block (slot of the block), mix_position (order by it), and
    the block's mix_release and mix_deadline in slots. Columns of these names are replaced."""
    shares = dict(shares or {})
    if default_share < 1 or any(s < 1 for s in shares.values()):
        raise ValueError("shares are positive whole numbers")
    spark, scratch = ship(docs.sparkSession), scratch_path(docs.sparkSession, "mixing")
    names = docs.columns
    inner = docs.toDF(*(f"__c{i}" for i in range(len(names))))
    id_, source = F.col(f"__c{names.index(id_col)}"), F.col(f"__c{names.index(source_col)}").cast("string")

    # a row per source, in the order of the names, null last
    own = F.lit(default_share).cast("long")
    for name, share in shares.items():
        own = F.when(F.col("name").eqNullSafe(F.lit(name)), F.lit(share).cast("long")).otherwise(own)
    counts = inner.groupBy(source.alias("name")).agg(F.count("*").alias("n"))
    counts = counts.repartitionByRange(F.col("name").isNull(), "name").sortWithinPartitions(F.col("name").isNull(), "name")
    counts.select(
        "name", own.alias("share"), F.ceil(F.col("n") / block_documents).alias("blocks"), F.ceil(F.col("n") / GROUP_DOCUMENTS).cast("int").alias("groups"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    ).write.parquet(f"{scratch}/sources")
    listed = spark.read.parquet(f"{scratch}/sources")
    parts = {r["part"]: r["n"] for r in listed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per task
    firsts = spark.createDataFrame(
        [(p, sum(n for q, n in parts.items() if q < p)) for p in parts] or [(0, 0)], "part int, before long")
    listed = listed.join(F.broadcast(firsts), "part").select(
        "name", "share", "blocks", "groups", (F.col("before") + F.col("at")).alias("source"))
    few = sum(parts.values()) <= shipped_sources

    first, longest = _changes(listed)
    active = listed.select("source", "blocks", "share").mapInArrow(_active(first), "segment long, source long, inside long")
    active.write.parquet(f"{scratch}/active")
    active = spark.read.parquet(f"{scratch}/active")
    slots = np.zeros(len(first), np.int64)
    for row in active.groupBy("segment").agg(F.sum("inside").alias("n")).collect():  # a row per change
        slots[row["segment"]] = row["n"]
    segments = Segments(first, slots, longest)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    active.repartition(partitions, "segment").groupBy("segment").applyInArrow(_pattern, _PATTERN).write.parquet(f"{scratch}/patterns")
    remove_path(spark, f"{scratch}/active")
    patterns = spark.read.parquet(f"{scratch}/patterns")
    shipped = few and int(slots.sum()) <= shipped_entries

    order = F.xxhash64(id_, *inner.columns)
    known = listed.select(F.col("name").alias("__name"), F.col("source").alias("__source"), F.col("share").alias("__share"), F.col("groups").alias("__groups"))
    inner = inner.join(F.broadcast(known) if few else known, source.eqNullSafe(F.col("__name"))).drop("__name")
    inner = inner.withColumn("__order", order).withColumn("__group", F.pmod("__order", "__groups").cast("int")).drop("__groups")

    before = inner.groupBy("__source", "__group").agg(F.count("*").alias("__n"))
    running = Window.partitionBy("__source").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("__source", "__group", F.coalesce(F.sum("__n").over(running), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__source", "__group").orderBy("__order", id_))
    placed = inner.withColumn("__number", number).join(before, ["__source", "__group"])
    placed = placed.withColumn("__number", (F.col("__number") - 1 + F.col("__before")).cast("long")).drop("__order", "__group", "__before")

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    if shipped:
        known = np.array([tuple(r) for r in patterns.collect()], np.int64).reshape(-1, 6).T  # at most ``shipped_entries`` rows
        placed = placed.mapInArrow(_with_slots(segments, block_documents, known), kinds + ", __slot long, __release long, __deadline long")
    else:
        placed = placed.mapInArrow(_with_slots(segments, block_documents, None), kinds + ", __segment long, __k long, __start long")
        own = patterns.select(F.col("segment").alias("__segment"), F.col("source").alias("__source"), F.col("k").alias("__k"), "slot", "release", "deadline")
        placed = placed.join(own, ["__segment", "__source", "__k"]).select(
            "*", *((F.col("__start") + F.col(c)).alias(f"__{c}") for c in ("slot", "release", "deadline")))
    position = F.col("__slot") * block_documents + F.col("__number") % block_documents
    places = zip(PLACES, (F.col("__slot"), position, F.col("__release"), F.col("__deadline")))
    return placed.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names) if c not in PLACES), *(p.alias(c) for c, p in places))
