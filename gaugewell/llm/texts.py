"""Whole texts as flat UTF-8 arrays: words, word names and the batches they come in.

Tasks receive Arrow batches; a column of texts is one byte array with one offset per
document. Everything here works on such arrays without an object per word, and a batch
is cut at document borders into pieces of bounded size (one long document is one piece).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.session import ship

PIECE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII bytes that are no letters; bytes of other scripts count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[128:] = NO_LETTER[ord("a"):ord("z") + 1] = NO_LETTER[ord("A"):ord("Z") + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_KINDS = np.arange(1, 257, dtype=np.uint16)
_KINDS[ord("A"):ord("Z") + 1] = 300
_KINDS[ord("a"):ord("z") + 1] = _KINDS[128:] = 301
_KINDS[ord("0"):ord("9") + 1] = 302

_MULTIPLIERS = (np.uint64(0x9E6C63D0876A3F35), np.uint64(0xC2B2AE3D27D4EB4F))
_weights: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or of one document."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def annotate(docs: DataFrame, compute: Callable[[np.ndarray, np.ndarray], dict[str, list]], schema: str,
             text_col: str = "text") -> tuple[DataFrame, list[Column]]:
    """The rows with computed columns beside them, and the columns that restore the given ones.

    Given columns pass under names of their own, so that no name of theirs can meet a computed one.
    ``compute`` gets the texts of a piece and returns a list per column of ``schema``.
    """
    ship(docs.sparkSession)
    names = docs.columns
    inner = docs.toDF(*(f"__c{i}" for i in range(len(names))))
    inner = inner.select(text_or_empty(F.col(f"__c{names.index(text_col)}")).alias("__text"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "__text"):
                found = compute(*utf8(piece.column(0)))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v) for v in found.values()), *piece.columns[1:]], [*found, *piece.schema.names[1:]])

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema[1:])
    return inner.mapInArrow(run, f"{schema}, {given}"), [F.col(f"__c{i}").alias(c) for i, c in enumerate(names)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def weights(seed: int, count: int) -> np.ndarray:
    """An odd number for each position, of no pattern: unlike powers, sums weighted by them cancel out for no regular text."""
    known = _weights.get(seed)
    if known is None or len(known) < count:
        known = _weights[seed] = mix(np.arange(max(count, 4096), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    return known[:count]


class Words:
    """The words of some documents: maximal byte runs without separators, which are ASCII white space.

    ``starts`` and ``ends`` are byte positions, ``bounds[d]:bounds[d + 1]`` are the
    words of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> None:
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        first = np.empty(len(data), bool)
        if len(data):
            first[0] = True
            np.logical_not(inside[:-1], out=first[1:])
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            first &= inside
            last = np.empty(len(data), bool)
            last[-1] = True
            np.logical_not(inside[1:], out=last[:-1])
            ending = offsets[1:] - 1
            last[ending[ending >= 0]] = True
            last &= inside
            self.ends = np.flatnonzero(last) + 1
        else:
            self.ends = np.zeros(0, np.int64)
        self.inside, self.first = inside, first
        self.starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))

    def names(self, which: int = 0) -> np.ndarray:
        """A 64-bit name per word, equal for equal words; ``which`` selects one of two families."""
        if not len(self):
            return np.zeros(0, np.uint64)
        data, at = self.data, np.arange(len(self.data))
        since = at - np.maximum.accumulate(np.where(self.first, at, 0))
        multiplier = _MULTIPLIERS[which]
        terms = (data.astype(np.uint64) + np.uint64(1)) * weights(int(multiplier), int(since.max()) + 1)[since]
        terms[~self.inside] = 0
        sums = np.add.reduceat(terms, self.starts)
        return mix(sums + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def shapes(self) -> np.ndarray:
        """A 64-bit name per word of its sequence of capitals, small letters, digits and marks, repeats as one."""
        if not len(self):
            return np.zeros(0, np.uint64)
        kind = _KINDS[self.data]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new = (new | self.first) & self.inside
        rank = np.cumsum(new)
        rank -= np.maximum.accumulate(np.where(self.first, rank, 0))
        terms = kind.astype(np.uint64) * weights(int(_MULTIPLIERS[0]), int(rank.max()) + 1)[np.maximum(rank, 0)]
        terms[~new] = 0
        return mix(np.add.reduceat(terms, self.starts))

    def prefixes(self, letters: int) -> np.ndarray:
        """A 64-bit name per word of its first bytes."""
        packed = np.zeros(len(self), np.uint64)
        for k in range(letters):
            at = self.starts + k
            inside = at < self.ends
            packed = packed * np.uint64(257) + np.where(inside, self.data[np.where(inside, at, self.starts)], 256)
        return mix(packed)


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the documents that ``bounds`` delimits; empty ones get 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
