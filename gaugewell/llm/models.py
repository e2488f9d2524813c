"""What the trained scorers share: sparse hashed features, a bounded labelled sample, one training task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.texts import mix, pieces, text_or_empty, utf8
from gaugewell.session import ship

BUCKET_BITS = 18
#: Labelled rows that a model is fitted on, at most; everything else covers all rows.
SAMPLE_ROWS = 8_000


class Sparse:
    """Rows of (bucket, value) pairs: row r has ``bounds[r]:bounds[r + 1]``. Values may be of single precision."""

    def __init__(self, bounds: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> None:
        self.bounds, self.buckets, self.values = bounds, buckets, values

    def parts(self, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
        """First and last row, behind it, of runs of rows with about ``most`` pairs each."""
        at, rows = 0, len(self.bounds) - 1
        while at < rows:
            end = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + most, "right")) - 1)
            yield at, end
            at = end

    def counts(self, chosen: np.ndarray, size: int) -> np.ndarray:
        """How many of the ``chosen`` rows have each bucket, a run of rows at a time."""
        total = np.zeros(size, np.int64)
        for a, b in self.parts():
            judge = np.repeat(chosen[a:b], np.diff(self.bounds[a:b + 1]))
            total += np.bincount(self.buckets[self.bounds[a]:self.bounds[b]][judge], minlength=size)
        return total

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.buckets].astype(np.float64) * self.values)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def grams(names: np.ndarray, documents: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and names of the runs of ``size`` words."""
    out = mix(names[:max(0, len(names) - size + 1)] + np.uint64(salt))
    for k in range(1, size):
        out = mix(out * np.uint64(31) + names[k:k + len(out)])
    whole = documents[:len(out)] == documents[size - 1:size - 1 + len(out)]
    return documents[:len(out)][whole], out[whole]


def counted(parts: list[tuple[np.ndarray, np.ndarray]], rows: int, bits: int = BUCKET_BITS) -> Sparse:
    """How often each bucket occurs in each of the documents."""
    owner = np.concatenate([p[0] for p in parts]).astype(np.int64)
    bucket = np.concatenate([p[1] for p in parts]) & np.uint64((1 << bits) - 1)
    keys, counts = np.unique(owner << bits | bucket.astype(np.int64), return_counts=True)
    bounds = np.searchsorted(keys >> bits, np.arange(rows + 1))
    return Sparse(bounds, (keys & ((1 << bits) - 1)).astype(np.int32), counts.astype(np.float64))


Features = Callable[[np.ndarray, np.ndarray], Sparse]


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, drawn by a hash of the id."""
    ship(docs.sparkSession)
    drawn = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).dropna()
        .orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    # the drawn rows are bounded by the parameter
    return texts.join(F.broadcast(drawn), "id").select("id", "label", "text")


def gathered(rows: pa.ChunkedArray, order: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in binary ``rows``, row after row in the given order, with the rows' bounds.

    They are copied once, out of Arrow's own memory; a list of them would hold every row twice more.
    """
    views = []
    for chunk in rows.chunks:
        _, offsets, data = chunk.buffers()
        wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        edges = np.frombuffer(offsets, wide)[chunk.offset:chunk.offset + len(chunk) + 1].tolist() if len(chunk) else []
        data = memoryview(data) if data is not None else memoryview(b"")
        views += [np.frombuffer(data[a:b], kind) for a, b in zip(edges[:-1], edges[1:])]
    bounds = np.concatenate([[0], np.cumsum([len(views[i]) for i in order.tolist()])]).astype(np.int64)
    out = np.empty(bounds[-1], kind)
    for place, i in enumerate(order.tolist()):
        out[bounds[place]:bounds[place + 1]] = views[i]
    return bounds, out


def fit(drawn: DataFrame, features: Features, train: Callable[[np.ndarray, Sparse], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Featurise the bounded sample where it lies, then train in one task; the model is of fixed size."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = features(*utf8(piece.column(2)))
                cut = list(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.string()), piece.column(1),
                     pa.array([found.buckets[a:b].tobytes() for a, b in cut], pa.binary()),
                     pa.array([found.values[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary())],
                    ["id", "label", "buckets", "vals"])

    def learn(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.select(["id", "label"]), [("id", "ascending"), ("label", "ascending")]).to_numpy()
        bounds, buckets = gathered(table.column("buckets"), order, np.int32)
        labels, values = table.column("label").to_numpy()[order], gathered(table.column("vals"), order, np.float32)[1]
        model = train(labels, Sparse(bounds, buckets, values))
        return pa.table({"name": list(model), "data": [np.asarray(v, np.float64).tobytes() for v in model.values()]})

    model = (
        drawn.mapInArrow(rows, "id string, label int, buckets binary, vals binary")
        .withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "name string, data binary").collect()
    )
    return {r["name"]: np.frombuffer(r["data"], np.float64) for r in model}


class FollowTheRegularisedLeader:
    """Per-coordinate steps with a first-order penalty that keeps most weights at zero."""

    def __init__(self, size: int, rate: float, smooth: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        step = (self.smooth + np.sqrt(n)) / self.rate + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def learn(self, at: np.ndarray, weights: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.rate * weights
        self.n[at] = more


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, np.float64)))


def scored(docs: DataFrame, features: Features, values: Callable[[Sparse], dict[str, np.ndarray]], schema: str,
           id_col: str, text_col: str) -> DataFrame:
    """The id and the computed columns for every document."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = values(features(*utf8(piece.column(1))))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(v) for v in found.values())], ["id", *found])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return texts.mapInArrow(rows, f"id {kind}, {schema}").withColumnRenamed("id", id_col)
