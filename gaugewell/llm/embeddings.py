"""Near-duplicate embeddings: exact cosine links by tiled comparison in the order of principal components.

Vectors are scaled to length one and rotated onto the principal axes of the whole table, which
leaves every cosine as it is and moves most of it into the leading coordinates. Two tiles are compared on a few leading
coordinates first. Each vector has the length of what is left as one coordinate more, so that one
matrix product gives the cosine's upper bound for all pairs of the tiles; the pairs that can still reach the
threshold go on coordinate by coordinate, and what remains is decided by its cosine in double precision.
Pairs of tiles whose leading coordinates are too far apart are not compared at all.

Equal vectors are compared once, with the number of their rows. A pair of tiles returns one row for each vector
that it links: how many rows it is linked to, and the centre of a star; pairs of vectors are
never listed. Tiles hold a bounded number of bytes.

Cases: a vector that is null or empty, holds a null or a component that is not finite, or has no length links
with nothing and is its own component; vectors of different dimensions do not link; repeated rows
and repeated ids are vectors of their own and link with each other; a null id is a component's least id only if
there is no other, and such a row is kept if it is alone with its like; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.components import components
from gaugewell.session import remove_path, scratch_path, ship

THRESHOLD = 0.9
TILE_BYTES = 32 << 20
LEAST_TILE = 1024
#: Tiles at least, where there are enough vectors, so that their pairs keep many tasks busy.
TILES = 12
_LEADING = 4
_AT_ONCE = 1 << 20
#: More than single precision can add to the bound of a product of two vectors of length one.
_SLACK = 1e-4


def _units(column: pa.ListArray) -> Iterator[tuple[int, bytes]]:
    """(row, vector in double precision) of the vectors that have a direction."""
    values = np.asarray(column.values.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64) + 0.0  # a negative zero is zero
    offsets = column.offsets.to_numpy()
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])[offsets]
    filled = np.concatenate([[0], np.cumsum(values != 0)])[offsets]
    fits = (np.diff(broken) == 0) & (np.diff(filled) > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    for row in np.flatnonzero(fits).tolist():
        yield row, values[offsets[row]:offsets[row + 1]].tobytes()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, vectors = [None] * batch.num_rows, [None] * batch.num_rows
        for row, vector in _units(batch.column(1)):
            keys[row], vectors[row] = hashlib.blake2b(vector, digest_size=16).digest(), vector
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ["id", "key", "vector"])


def scaled(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one dimension at length one, whatever the size of their components."""
    found = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, vectors of length one)."""
    vectors = column.to_pylist()
    size = np.array([len(v) // 8 for v in vectors], np.int64)
    for dimension in np.unique(size).tolist():
        rows = np.flatnonzero(size == dimension)
        yield dimension, rows, scaled([vectors[i] for i in rows])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of outer products of a task's vectors, a row of it at a time, with their number."""
    total: dict[int, list] = {}
    for batch in batches:
        for dimension, rows, units in _by_dimension(batch.column(0)):
            known = total.setdefault(dimension, [0, np.zeros((dimension, dimension))])
            known[0] += len(rows)
            known[1] += units.T @ units
    for dimension, (count, matrix) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dimension] * dimension, pa.int64()), pa.array(range(dimension), pa.int64()), pa.array([count] * dimension, pa.int64()),
             pa.array([row.tobytes() for row in matrix], pa.binary())], ["dimension", "at", "n", "sums"])


def _sum(rows: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(v, np.float64) for v in rows.column("sums").to_pylist())
    return pa.table({"dimension": rows.column("dimension")[:1], "at": rows.column("at")[:1],
                     "n": [sum(rows.column("n").to_pylist())], "sums": pa.array([sums.tobytes()], pa.binary())})


def principal_axes(vectors: DataFrame, dimensions: int = 8) -> dict[int, np.ndarray]:
    """Axes as columns, in falling order of their share, of the dimensions with most vectors.

    Others keep the axes they are given in, which changes their speed only. The driver gets a
    row of numbers for each axis.
    """
    schema = "dimension long, at long, n long, sums binary"
    sums = vectors.select("vector").mapInArrow(_products, schema)
    sums = sums.repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "dimension", "at")
    sums = sums.groupBy("dimension", "at").applyInArrow(_sum, schema)
    common = sums.where("at = 0").select("dimension", "n").orderBy(F.desc("n"), "dimension").limit(dimensions)
    found: dict[int, list] = {}
    for row in sums.join(F.broadcast(common.select("dimension")), "dimension", "left_semi").orderBy("dimension", "at").collect():
        found.setdefault(row["dimension"], []).append(np.frombuffer(row["sums"], np.float64))
    return {dimension: np.linalg.eigh(np.array(rows))[1][:, ::-1].copy() for dimension, rows in found.items()}


def _rotated(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    return units @ axes[units.shape[1]] if units.shape[1] in axes else units


def _places(axes: dict[int, np.ndarray]):
    """The first coordinate of each vector, by which tiles are made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, first = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for dimension, rows, units in _by_dimension(batch.column(batch.schema.get_field_index("vector"))):
                size[rows], first[rows] = dimension, _rotated(units, axes)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(first), *batch.columns], ["dimension", "first", *batch.schema.names])
    return run


def _tiles(axes: dict[int, np.ndarray], tile_rows: int, tile_bytes: int):
    """The vectors of a task, sorted by dimension and first coordinate, as tiles of one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0

        def pack() -> pa.RecordBatch:
            nonlocal number
            tile = (TaskContext.get().partitionId() << 20) + number
            number += 1
            vectors = [v for _, _, v in held]
            lead = _rotated(scaled(vectors), axes)[:, :_LEADING]
            lead = np.pad(lead, ((0, 0), (0, _LEADING - lead.shape[1])))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (tile, pa.int64()), (size, pa.int64()), (lead.min(axis=0).tolist(), pa.list_(pa.float64())),
                    (lead.max(axis=0).tolist(), pa.list_(pa.float64())), ([k for k, _, _ in held], pa.list_(pa.binary())),
                    ([w for _, w, _ in held], pa.list_(pa.int64())), (b"".join(vectors), pa.binary()))],
                ["tile", "dimension", "low", "high", "keys", "weights", "vectors"])

        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in ("dimension", "key", "weight", "vector"))):
                full = min(tile_rows, max(1, tile_bytes // (8 * row[0])))
                if held and (row[0] != size or len(held) >= full):
                    yield pack()
                    held = []
                size = row[0]
                held.append(row[1:])
        if held:
            yield pack()
    return run


def _partners(tiles: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float):
    """(x, y) for each tile x and the tiles from x on that can hold a link to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column(0).to_pylist():
                at = int(np.searchsorted(tiles, tile))
                gap = np.maximum(0, np.maximum(low[at:] - high[at], low[at] - high[at:]))
                # vectors of length one and cosine c are sqrt(2 - 2 c) apart
                near = (size[at:] == size[at]) & ((gap ** 2).sum(axis=1) <= 2 - 2 * threshold + _SLACK)
                found = tiles[at:][near]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), tile)), pa.array(found)], ["x", "y"])
    return run


def links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) with a cosine of at least ``threshold``; without b those of a, each once.

    ``a`` and ``b`` hold vectors of length one.
    """
    width = a.shape[1]
    steps = [min(width, max(8, width // 4))]
    while steps[-1] < width:
        steps.append(min(width, 2 * steps[-1]))
    sides = []
    for side in (a,) if b is None else (a, b):
        turned = side if axes is None else side @ axes
        rest = np.cumsum((turned ** 2)[:, ::-1], axis=1)[:, ::-1]
        # the length of what is left behind each step
        rests = [np.sqrt(rest[:, s]) if s < width else np.zeros(len(side)) for s in steps]
        bound = np.concatenate([turned[:, :steps[0]], rests[0][:, None]], axis=1).astype(np.float32)
        sides.append((side, turned, rests, bound))
    (one, one_turned, one_rests, one_bound), (two, two_turned, two_rests, two_bound) = sides[0], sides[-1]
    step = max(1, _AT_ONCE // max(1, len(two)))
    for at in range(0, len(one), step):
        begin = at if b is None else 0
        i, j = np.nonzero(one_bound[at:at + step] @ two_bound[begin:].T >= threshold - _SLACK)
        i, j = i + at, j + begin
        if b is None:
            i, j = i[i < j], j[i < j]
        for first in range(0, len(i), _AT_ONCE // 4):
            x, y = i[first:first + _AT_ONCE // 4], j[first:first + _AT_ONCE // 4]
            reached = np.einsum("ij,ij->i", one_turned[x, :steps[0]], two_turned[y, :steps[0]])
            for k in range(1, len(steps)):
                stays = reached + one_rests[k - 1][x] * two_rests[k - 1][y] >= threshold - _SLACK
                x, y, reached = x[stays], y[stays], reached[stays]
                part = slice(steps[k - 1], steps[k])
                reached = reached + np.einsum("ij,ij->i", one_turned[x, part], two_turned[y, part])
            stays = reached >= threshold - _SLACK
            x, y = x[stays], y[stays]
            linked = np.einsum("ij,ij->i", one[x], two[y]) >= threshold
            if linked.any():
                yield x[linked], y[linked]


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Let the nodes x and y share the least root; ``root`` is a flat forest before and after."""
    x, y = root[x], root[y]
    while (apart := x != y).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root[:] = up
        x, y = root[x], root[y]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("tile").to_numpy(), kind="stable")[:2].tolist()
        if rows.column("x")[0].as_py() == rows.column("y")[0].as_py():
            order = order[:1]
        size = rows.column("dimension")[0].as_py()
        units, keys, weights = [], [], []
        for i in order:
            data = rows.column("vectors")[i].as_py()
            units.append(scaled([data[at:at + 8 * size] for at in range(0, len(data), 8 * size)]))
            keys += rows.column("keys")[i].as_py()
            weights.append(np.array(rows.column("weights")[i].as_py(), np.int64))
        shift = len(units[0]) if len(units) > 1 else 0
        weight = np.concatenate(weights)
        total, root = np.zeros(len(weight), np.int64), np.arange(len(weight))
        for x, y in links(units[0], units[1] if shift else None, axes.get(size), threshold):
            y = y + shift
            np.add.at(total, x, weight[y])
            np.add.at(total, y, weight[x])
            _joined(root, x, y)
        found = np.flatnonzero(total)
        keys = pa.array(keys, pa.binary())
        return pa.table({"key": keys.take(pa.array(found)), "n": total[found], "centre": keys.take(pa.array(root[found]))})
    return run


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, tiles: int = TILES, least_tile: int = LEAST_TILE, tile_bytes: int = TILE_BYTES,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per vector: id, n_links (rows linked directly), component_id (least id that links reach), kept (has that id)."""
    spark, scratch = ship(table.sparkSession), scratch_path(table.sparkSession, "embeddings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = table.schema[id_col].dataType
    given = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    given.mapInArrow(_keys, f"id {id_type.simpleString()}, key binary, vector binary").write.parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    valid = rows.where("key is not null")
    axes = principal_axes(valid)

    # a row per distinct vector; equal vectors are counted before they are dealt
    distinct = valid.groupBy("key", "vector").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    distinct.write.parquet(f"{scratch}/distinct")
    distinct = spark.read.parquet(f"{scratch}/distinct")
    tile_rows = max(least_tile, -(-distinct.count() // tiles))
    placed = distinct.select("key", "weight", "vector").mapInArrow(
        _places(axes), "dimension long, first double, key binary, weight long, vector binary")
    placed = placed.repartitionByRange(tiles, "dimension", "first").sortWithinPartitions("dimension", "first")
    placed.mapInArrow(
        _tiles(axes, tile_rows, tile_bytes),
        "tile long, dimension long, low array<double>, high array<double>, keys array<binary>, weights array<long>, vectors binary",
    ).write.parquet(f"{scratch}/tiles")
    packed = spark.read.parquet(f"{scratch}/tiles")

    # a few numbers a tile, of which there are as many as tiles of the bounded size
    boxes = packed.select("tile", "dimension", "low", "high").orderBy("tile").collect()
    if not boxes:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    box = [np.array([b[c] for b in boxes]) for c in ("tile", "dimension", "low", "high")]
    pairs = packed.select("tile").mapInArrow(_partners(*box, threshold), "x long, y long")
    ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("tile"))
    met = ends.join(packed.select("tile", "dimension", "keys", "weights", "vectors").hint("shuffle_hash"), "tile")
    met.repartition(parts, "x", "y").groupBy("x", "y").applyInArrow(
        _compare(axes, threshold), "key binary, n long, centre binary").write.parquet(f"{scratch}/links")
    remove_path(spark, f"{scratch}/tiles")

    linked = spark.read.parquet(f"{scratch}/links")
    roots = components(linked.select("key", "centre")).toDF("key", "root")
    named = roots.join(distinct.select("key", "least"), "key")
    named.groupBy("root").agg(F.min("least").alias("component_id")).write.parquet(f"{scratch}/classes")
    # between two plain shuffles, so that a class of many vectors can be split
    classes = roots.join(spark.read.parquet(f"{scratch}/classes"), "root").select("key", "component_id")
    degrees = linked.groupBy("key").agg(F.sum("n").alias("n"))
    distinct.select("key", "least", "weight").join(degrees, "key", "left").join(classes, "key", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"),
    ).write.parquet(f"{scratch}/named")
    for done in ("distinct", "links", "classes"):
        remove_path(spark, f"{scratch}/{done}")
    found = rows.select("id", "key").join(spark.read.parquet(f"{scratch}/named"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"))
