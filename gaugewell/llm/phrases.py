"""Document fingerprints from locally consistent parsing by deterministic coin tossing.

Level by level, runs of equal symbols become one symbol, neighbours toss coins (the place
and value of the lowest bit in which a symbol differs from the one before it) until the labels
are few, and local maxima of the labels begin new phrases. A phrase is named by its content and is a
symbol of the next level. Where phrases begin depends on a few neighbours only, so equal
substrings share the phrases of their interior wherever they stand. A fingerprint keeps the
smallest names of the upper levels; two of them estimate the share of common phrases.

Cases: null and empty texts have an empty fingerprint, like only to another empty one; equal
texts have equal fingerprints; rows of equal id follow each other by a hash of their text; null ids
come last; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.llm.texts import mix, pieces, weights, text_or_empty, utf8
from gaugewell.session import ship

LEVELS = (2, 3)  # whose phrases make the fingerprint; about 10 and 30 bytes long
KEPT = 64
_NAME = 0x9E6C63D0876A3F35
#: The place of the lowest set bit of each byte; the label for equal neighbours is that of bit 0.
_LOWEST = np.array([0, *((x & -x).bit_length() - 1 for x in range(1, 256))], np.uint8)
_TOSSES = 3


def _before(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The value to the left; a document's first symbol meets its own complement."""
    left = np.empty_like(values)
    left[1:] = values[:-1]
    left[first] = ~values[first]
    return left


def _starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin, given symbols of which no two neighbours are equal."""
    if symbols.dtype == np.uint8:
        place = _LOWEST[symbols ^ _before(symbols, first)]
    else:
        differ = symbols ^ _before(symbols, first)
        place = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    labels = (2 * place + (symbols >> place.astype(symbols.dtype) & symbols.dtype.type(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(_TOSSES):
        place = _LOWEST[labels ^ _before(labels, first)]
        labels = 2 * place + (labels >> place & 1)
    begins = np.zeros(len(labels), bool)
    begins[1:] = labels[1:] > labels[:-1]
    begins[:-1] &= labels[:-1] >= labels[1:]
    begins[first] = True
    return np.flatnonzero(begins)


def phrase_names(data: np.ndarray, offsets: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each wanted level the names of its phrases and where those of each document begin."""
    out = []
    symbols, bounds = data, np.asarray(offsets, np.int64)
    for level in range(1, max(levels) + 1):
        if not len(symbols):
            out.append((np.zeros(0, np.uint64), bounds))
            continue
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        # runs
        new = np.ones(len(symbols), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        new[first] = True
        heads = np.flatnonzero(new)
        run = np.diff(np.append(heads, len(symbols))).astype(np.uint64)
        symbols, bounds = symbols[heads], np.searchsorted(heads, bounds)
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        names = mix(symbols.astype(np.uint64) + run * np.uint64(0xD6E8FEB86659FD93))
        # phrases
        begins = _starts(symbols, first)
        length = np.diff(np.append(begins, len(symbols)))
        within = np.arange(len(symbols)) - np.repeat(begins, length)
        names = np.add.reduceat(names * weights(_NAME, int(length.max()))[within], begins)
        symbols = mix(names + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        bounds = np.searchsorted(begins, bounds)
        out.append((symbols, bounds))
    return [out[level - 1] for level in levels]


def sketches(data: np.ndarray, offsets: np.ndarray, kept: int = KEPT) -> list[np.ndarray]:
    """For each document its ``kept`` smallest phrase names (32 bits each, ascending)."""
    levels = [((mix(names + np.uint64(level)) >> np.uint64(32)).astype(np.uint32), bounds.tolist())
              for level, (names, bounds) in zip(LEVELS, phrase_names(data, offsets))]
    out = []
    for document in range(len(offsets) - 1):
        names = np.concatenate([n[b[document]:b[document + 1]] for n, b in levels])
        if len(names) > 8 * kept:  # the smallest alone, with room for repeats
            least = np.unique(np.partition(names, 4 * kept)[:4 * kept])
            names = least if len(least) >= kept else names
        out.append(np.unique(names)[:kept])
    return out


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated share of common phrases: of the smallest names of both together, those in both."""
    if not len(a) and not len(b):
        return 1.0
    both, count = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((count[:kept] == 2).sum() / min(kept, len(both)))


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _sketch_texts(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for piece in pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        out.extend(sketches(*utf8(piece.column(0))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, fingerprint (hexadecimal)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = [_hex(s) for s in sketches(*utf8(piece.column(1)))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.string())], ["id", "fingerprint"])

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


_TOGETHER = 256


def _compare_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is compared with the row behind it in the same bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    held: list[tuple] = []  # the last row, which waits for its next one
    for batch in batches:
        for at in range(0, batch.num_rows, _TOGETHER):
            rows = batch.slice(at, _TOGETHER)
            texts = [unpack(p).decode() for p in rows.column(rows.schema.get_field_index("packed")).to_pylist()]
            buckets, edges, ids = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("bucket", "edge", "id"))
            own = held + list(zip(buckets, edges, ids, texts, _sketch_texts(texts)))
            pairs = [(a, b) for a, b in zip(own, own[1:]) if a[0] == b[0] and not a[1]]
            held = own[-1:]
            if not pairs:
                continue
            edited = [a[3][:len(a[3]) - len(a[3]) // 2] + b[3][:len(a[3]) // 2] for a, b in pairs]
            others = _sketch_texts(edited)
            yield pa.RecordBatch.from_arrays([
                pa.array([a[2] for a, _ in pairs], pa.int64()),
                pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([_hex(a[4]) for a, _ in pairs]),
                pa.array([_hex(s) for s in others]),
                pa.array([likeness(a[4], s) for (a, _), s in zip(pairs, others)]),
                pa.array([likeness(a[4], b[4]) for a, b in pairs]),
            ], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


class _Cuts:
    """Borders of ranges of (key, order), both falling, numbered from the largest down."""

    def __init__(self, cuts: list[tuple[int, int]]) -> None:
        self.keys = np.array([k for k, _ in cuts], np.int64)
        self.orders = np.array([o for _, o in cuts], np.int64)

    def ranges(self, keys: np.ndarray, orders: np.ndarray) -> np.ndarray:
        below = np.searchsorted(self.keys, keys, "left")
        if len(self.keys):
            at = np.flatnonzero(self.keys[np.minimum(below, len(self.keys) - 1)] == keys)
            # rows whose key is a border, by the borders that this key has
            for key in np.unique(keys[at]):
                rows = at[keys[at] == key]
                own = np.flatnonzero(self.keys == key)
                below[rows] = own[0] + np.searchsorted(self.orders[own], orders[rows], "right")
        return len(self.keys) - below


def _cut_places(rows: DataFrame, ranges: int) -> _Cuts:
    """Borders of about equally many rows. A key that fills several ranges is cut by the order of its rows."""
    if ranges < 2:
        return _Cuts([])
    places = rows.select("key").approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    count = Counter(_whole(p) for p in places)
    cuts = [(k, np.iinfo(np.int64).min) for k in count]
    hot = {k: n for k, n in count.items() if n > 1}
    if hot:
        shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
        found = rows.where(F.col("key").isin(list(hot))).groupBy("key").agg(F.percentile_approx("order", shares, F.lit(4 * ranges)).alias("orders"))
        for row in found.collect():  # the keys that fill several ranges
            cuts += [(row["key"], o) for o in row["orders"][::max(1, ranges // (hot[row["key"]] + 1))]]
    return _Cuts(sorted(set(cuts)))


def _whole(place: float) -> int:
    return int(min(max(place, -(1 << 63)), (1 << 63) - 1024))


def _ranges(cuts: _Cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = cuts.ranges(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], ["bucket", "key", "order"])
    return run


def _pack(cuts: _Cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            bucket, text = cuts.ranges(batch.column(1).to_numpy(), batch.column(2).to_numpy()), batch.column(3)
            packed = [pack(text[i].as_buffer()) for i in range(len(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), *batch.columns[:3], pa.array(packed, pa.binary())],
                ["bucket", "id", "key", "order", "packed"])
    return run


#: Bits of the order of rows with one id that tell copies apart, which may stand in any order.
_COPY_BITS = 20


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text and the likeness to that and to the next document.

    The edited text has its last half replaced by the beginning of the next document in
    descending order of the id; the first one follows the last.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError("ids must be whole numbers")
    spark = ship(docs.sparkSession)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = -(1 << 63)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("key"),
        text_or_empty(F.col(text_col)).alias("text"))
    # rows of one id by a hash of their texts; the last bits spread copies
    copies = F.lit((1 << _COPY_BITS) - 1)
    order = F.xxhash64("text").bitwiseAND(F.bitwise_not(copies)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(copies))
    texts = texts.select("id", "key", order.alias("order"), "text")
    # as many ranges as there are partitions, found from the ids alone
    cuts = _cut_places(texts.select("key", "order"), max(1, partitions * 2))
    rows = texts.mapInArrow(_pack(cuts), "bucket int, id long, key long, order long, packed binary")

    # the first row of each range also stands behind the last row of the range before it
    firsts = (
        texts.select("key", "order").mapInArrow(_ranges(cuts), "bucket int, key long, order long")
        .groupBy("bucket").agg(F.max(F.struct("key", "order")).alias("first")).orderBy("bucket").collect()  # a row per range
    )
    behind = [(firsts[i - 1]["bucket"], *r["first"]) for i, r in enumerate(firsts)]
    if not behind:
        return rows.mapInArrow(_compare_with_next, _LIKENESS).withColumnRenamed("id", id_col)
    wanted = spark.createDataFrame(behind, "before int, key long, order long")
    heads = texts.join(F.broadcast(wanted), ["key", "order"]).groupBy("before").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("id"), F.col("before").cast("long").alias("key"), F.lit(0).cast("long").alias("order"), "text")
    edges = heads.mapInArrow(_pack(_Cuts([])), "bucket int, id long, key long, order long, packed binary").withColumn("bucket", F.col("key").cast("int"))
    both = rows.withColumn("edge", F.lit(False)).unionByName(edges.withColumn("edge", F.lit(True)))
    ordered = both.repartition(partitions, "bucket").sortWithinPartitions("bucket", "edge", F.desc("key"), F.desc("order"))
    return ordered.mapInArrow(_compare_with_next, _LIKENESS).withColumnRenamed("id", id_col)


_LIKENESS = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
