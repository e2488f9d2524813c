"""Near-duplicate classes from 64-bit SimHash fingerprints, compared exactly in tiles.

Distinct fingerprints are dealt into tiles by their population count. Two fingerprints
within the radius differ by no more than it in that count too, so pairs of tiles whose
counts are further apart are skipped; every other pair is compared in full with exclusive-or
and bit counts. A pair of tiles returns a star for each class it links, never all its pairs;
components over those stars give the classes.

Cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle count as one shingle; equal texts share a fingerprint; a null id stays in its
row and is the least of a class only if there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.components import components
from gaugewell.llm.texts import LOWER, Words, annotate, pieces, text_or_empty, utf8
from gaugewell.session import remove_path, scratch_path, ship

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE = 1 << 15
_AT_ONCE = 1 << 17


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each document, as unsigned 64-bit integers."""
    words = Words(LOWER[data], offsets)
    count = np.diff(words.bounds)
    result = np.zeros(len(count), np.uint64)
    if not len(words):
        return result
    plain = words.data  # a fresh array: single separators can become spaces in place
    gaps = words.starts[1:] - words.ends[:-1]
    plain[words.ends[:-1][gaps == 1]] = 0x20
    shingles = np.maximum(count - shingle + 1, (count > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(edges[-1]) - np.repeat(edges[:-1] - words.bounds[:-1], shingles)
    last = np.minimum(first + shingle, np.repeat(words.bounds[1:], shingles)) - 1
    wide = np.concatenate([[0], np.cumsum(gaps != 1), [0]])
    crooked = np.flatnonzero(wide[last] != wide[first])  # separators of several bytes inside
    text, digest = plain.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(text[s:e], SEED) for s, e in zip(words.starts[first].tolist(), words.ends[last].tolist())]
    for i in crooked.tolist():
        s, e = words.starts[first[i]], words.ends[last[i]]
        hashes[i] = digest(b" ".join(text[s:e].split()), SEED)
    hashes = np.array(hashes, np.uint64)
    filled = np.flatnonzero(count)
    for documents in np.array_split(filled, max(1, len(hashes) >> 14)):
        if not len(documents):
            continue
        low, high = edges[documents[0]], edges[documents[-1] + 1]
        bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[documents] - low, axis=0, dtype=np.int32)
        over = 2 * ones > shingles[documents][:, None]
        result[documents] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = fingerprints(*utf8(piece.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.view(np.int64))], ["id", "fp"])
    return run


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the fingerprints of one tile, or of two, that link within the radius: (member, centre)."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    root = np.arange(len(nodes))
    step = max(1, min(len(a), _AT_ONCE // max(1, len(other))))
    differ, bits = np.empty((step, len(other)), np.uint64), np.empty((step, len(other)), np.uint8)
    for at in range(0, len(a), step):
        rows = a[at:at + step, None]
        # into the same arrays again and again, which stay in the cache
        count = np.bitwise_count(np.bitwise_xor(rows, other[None, :], out=differ[:len(rows)]), out=bits[:len(rows)])
        if not count.size or count.min() > radius:
            continue
        i, j = np.nonzero(count <= radius)
        x, y = root[i + at], root[j + shift]
        while True:
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            x, y = root[x], root[y]
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[member], nodes[root[member]]


def _compare(radius: int):
    def run(rows: pa.Table) -> pa.Table:
        tiles = [np.array(t, np.int64).view(np.uint64) for t in rows.column("fps").to_pylist()]
        member, centre = links(tiles[0], tiles[1] if len(tiles) > 1 else None, radius)
        return pa.table({"a": member.view(np.int64), "b": centre.view(np.int64)})
    return run


def _edges(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """Stars of linked fingerprints from all pairs of tiles within the radius."""
    distinct = distinct.select("fp", F.bit_count("fp").alias("ones"))
    counts = {r["ones"]: r["n"] for r in distinct.groupBy("ones").agg(F.count("*").alias("n")).collect()}  # at most 65 rows
    tiles = [-(-counts.get(ones, 0) // tile) for ones in range(65)]
    before = [sum(tiles[:ones]) for ones in range(66)]
    spark = distinct.sparkSession
    layout = F.array(*(F.lit(t) for t in tiles)), F.array(*(F.lit(t) for t in before))
    packed = (
        distinct
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.get(layout[0], F.col("ones"))) + F.get(layout[1], F.col("ones")))
        .groupBy("tile", "ones").agg(F.collect_list("fp").alias("fps"))  # of bounded size
    )
    first = F.get(layout[1], F.greatest(F.col("ones") - radius, F.lit(0)))
    last = F.get(layout[1], F.least(F.col("ones") + radius, F.lit(64)) + 1) - 1
    pairs = packed.withColumn("other", F.explode(F.sequence(first, last)))
    pairs = pairs.select(F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "fps")
    return pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "x", "y").groupBy("x", "y").applyInArrow(
        _compare(radius), "a long, b long")


def _classes(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fp, least, root, class_least) of distinct fingerprints with the least of their rows, and that of their class."""
    linked = components(_edges(distinct, radius, tile)).withColumnRenamed("node", "fp")
    named = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("class_least"))
    # a struct as key: see components
    return named.join(least.select(F.struct("root").alias("k"), "class_least"), F.struct(named["root"]) == F.col("k")).drop("k")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, tile: int = TILE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), component_id (least id of its class),
    class_fingerprint (one fingerprint that stands for the class)."""
    spark, scratch = ship(docs.sparkSession), scratch_path(docs.sparkSession, "simhash")
    id_type = docs.schema[id_col].dataType
    (
        docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
        .mapInArrow(_fingerprint_batches(shingle), f"id {id_type.simpleString()}, fp long")
        .write.parquet(f"{scratch}/fingerprints")
    )
    marked = spark.read.parquet(f"{scratch}/fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    distinct.write.parquet(f"{scratch}/distinct")
    # stored, so that the join below is between two plain shuffles and a fingerprint of many copies can be split
    _classes(spark.read.parquet(f"{scratch}/distinct"), radius, tile).write.parquet(f"{scratch}/classes")
    remove_path(spark, f"{scratch}/distinct")
    return marked.join(spark.read.parquet(f"{scratch}/classes"), "fp").select(
        F.col("id").alias(id_col), _digits("fp").alias("fingerprint"), F.col("class_least").alias("component_id"),
        _digits("root").alias("class_fingerprint"))


def _digits(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def drop_near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE_WORDS, radius: int = RADIUS, tile: int = TILE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one document of each class: that of the least id, any before none.

    Rows are stored once, with their fingerprints and numbers of their own. Fingerprints know their least
    row, classes their least fingerprint's, and what stays is found by its number; no join meets a fingerprint of many rows.
    """
    spark, scratch = ship(docs.sparkSession), scratch_path(docs.sparkSession, "simhash")
    rows, given = annotate(
        docs, lambda data, offsets: {"__fp": fingerprints(data, offsets, shingle).view(np.int64)}, "__fp long", text_col)
    rows.withColumn("__row", F.monotonically_increasing_id()).write.parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    id_ = F.col(f"__c{docs.columns.index(id_col)}")
    least = F.min(F.struct(id_.isNull().alias("none"), id_.alias("id"), F.col("__fp").alias("fp"), F.col("__row").alias("row"))).alias("least")
    rows.groupBy(F.col("__fp").alias("fp")).agg(least).write.parquet(f"{scratch}/distinct")
    stays = _classes(spark.read.parquet(f"{scratch}/distinct"), radius, tile).where("least = class_least")
    return rows.join(stays.select(F.col("least.row").alias("__row")), "__row", "left_semi").select(*given)
