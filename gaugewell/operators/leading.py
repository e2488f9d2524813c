"""Leading values and distinct counts of columns with too many values to shuffle.

An exact profile moves every distinct value once. Where a column is nearly unique that is the whole column, though only its
most frequent values are asked for. Here every task keeps a bounded summary of its values: the counts of up to
``capacity`` of them, from which the least are dropped when there are too many, with a bound on how often a value that was
dropped can have come. The summaries meet as candidates with a bound on all others; one more pass counts the candidates
exactly. The result is exact if the last of the leading values came more often than any value that is no candidate can
have; where it did not, which the counts show, all values are counted.

Distinct values are counted exactly by default of the profile; ``distinct_estimate`` is the sketch beside it, of a stated
relative error and a shuffle of one sketch a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugewell.functions.text import value_text
from gaugewell.session import ship

CAPACITY = 4096
#: Logarithm of the registers of a distinct count; the relative error is about 1.04 / sqrt(2 ** registers).
REGISTERS = 14


@dataclass
class Leading:
    """Leading values, and how they were found."""

    frame: DataFrame  # field, position, value, frequency
    #: How many values were counted again, without fields that were counted whole at once.
    candidates: int
    #: The most that a value of each field can have come that is no candidate.
    bounds: dict[str, int]
    #: Fields for which the bound did not suffice, so that all their values were counted.
    recounted: list[str]


def _cells(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value): the filled cells of the fields as texts."""
    items = []
    for name in fields:
        items += [F.lit(name), value_text(df["`" + name.replace("`", "``") + "`"], df.schema[name].dataType)]
    return df.select(F.stack(F.lit(len(fields)), *items).alias("field", "value")).where("value is not null")


class Summary:
    """Counts of at most ``capacity`` values after each batch; a dropped value came at most ``bound`` times."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bound = capacity, 0
        self.known: pa.Table | None = None

    def add(self, values: pa.Array) -> None:
        counts = values.value_counts()
        rows = pa.table({"value": counts.field(0).cast(pa.large_string()), "n": counts.field(1).cast(pa.int64())})
        if self.known is not None:
            rows = pa.concat_tables([self.known, rows]).group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"])
        if rows.num_rows > self.capacity:
            n = rows.column("n").to_numpy()
            order = np.argsort(-n, kind="stable")
            # a value that is dropped may have been dropped before: the bounds add up
            self.bound += int(n[order[self.capacity]])
            rows = rows.take(pa.array(order[:self.capacity]))
        self.known = rows

    def rows(self) -> tuple[list[str], list[int]]:
        return ([], []) if self.known is None else (self.known.column("value").to_pylist(), self.known.column("n").to_pylist())


def _summarize(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Summary] = {}
        for batch in batches:
            fields = batch.column(0).dictionary_encode()
            for code, field in enumerate(fields.dictionary.to_pylist()):
                rows = np.flatnonzero(fields.indices.to_numpy() == code)
                found.setdefault(field, Summary(capacity)).add(batch.column(1).take(pa.array(rows)))
        for field, summary in found.items():
            values, counts = summary.rows()
            # what the task has dropped: a row without value
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * (len(values) + 1)), pa.array([*values, None], pa.string()), pa.array([*counts, summary.bound], pa.int64())],
                ["field", "value", "n"])
    return run


def _ranked(counted: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("field").orderBy(F.col("frequency").desc(), F.col("value").asc())
    return counted.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top).select("field", "position", "value", "frequency")


def leading_values(df: DataFrame, fields: list[str] | None = None, top: int = 20, capacity: int = CAPACITY) -> Leading:
    """The ``top`` values of each field with their exact frequencies; ties go to the smaller value."""
    spark, fields = ship(df.sparkSession), fields or df.columns
    cells = _cells(df, fields)
    summaries = cells.mapInArrow(_summarize(capacity), "field string, value string, n long")
    # a value is kept by some tasks and may be dropped by others; each task's bound holds for what it has dropped
    # kept while it is asked, so that the values are read and summarized once
    met = summaries.groupBy("field", "value").agg(F.sum("n").alias("n")).persist()
    bounds = {r["field"]: r["n"] for r in met.where("value is null").collect()}  # a row for each field
    # no value can lead whose count with all that tasks may have dropped is below the top-th known count
    ranked = _ranked(met.where("value is not null").withColumnRenamed("n", "frequency"), top)
    least = {r["field"]: r["least"] for r in ranked.groupBy("field").agg(F.min("frequency").alias("least"), F.max("position").alias("last")).collect() if r["last"] == top}
    rows = [(f, max(0, least.get(f, 0) - b)) for f, b in bounds.items()]
    floors = spark.createDataFrame(rows, "field string, floor long")
    candidates = met.where("value is not null").join(F.broadcast(floors), "field").where("n >= floor").select("field", "value")
    # where the bounds rule out too little, a field is counted whole at once: its candidates would be nearly all its values
    numbers = {r["field"]: r["count"] for r in candidates.groupBy("field").count().collect()}
    wide = [f for f in bounds if numbers.get(f, 0) > capacity]
    kept = candidates.where(~F.col("field").isin(wide)).collect()  # at most ``capacity`` for each field
    met.unpersist()
    number = len(kept)
    small = spark.createDataFrame([tuple(r) for r in kept], "field string, value string")
    counted = cells.join(F.broadcast(small), ["field", "value"], "left_semi")
    exact = _ranked(counted.groupBy("field", "value").agg(F.count(F.lit(1)).alias("frequency")), top)
    found = exact.collect() if kept else []  # at most ``top`` rows for each field
    lowest = {f: [r["frequency"] for r in found if r["field"] == f] for f in bounds}
    # a value that no task has kept came at most as often as all tasks together may have dropped; a tie could be smaller
    open_ = [f for f, b in bounds.items() if f in wide or b and (len(lowest[f]) < top or lowest[f][-1] <= b)]
    rows = [tuple(r) for r in found if r["field"] not in open_]
    frame = spark.createDataFrame(rows, "field string, position int, value string, frequency long")
    if open_:
        whole = _cells(df, open_).groupBy("field", "value").agg(F.count(F.lit(1)).alias("frequency"))
        frame = frame.union(_ranked(whole, top))
    return Leading(frame, number, bounds, open_)


def distinct_estimate(df: DataFrame, fields: list[str] | None = None, registers: int = REGISTERS) -> DataFrame:
    """(field, distinct): about how many values each field has, from sketches that tasks merge."""
    fields = fields or df.columns
    sketches = [
        F.hll_sketch_estimate(F.hll_sketch_agg(value_text(df["`" + n.replace("`", "``") + "`"], df.schema[n].dataType), F.lit(registers))).alias(f"d{i}")
        for i, n in enumerate(fields)]
    found = df.agg(*sketches)
    items = []
    for i, name in enumerate(fields):
        items += [F.lit(name), F.coalesce(F.col(f"d{i}"), F.lit(0).cast("long"))]
    return found.select(F.stack(F.lit(len(fields)), *items).alias("field", "distinct"))
