"""Prefix tries of conversations: double arrays over shards, shared upper nodes merged globally.

Turns get dense numbers, and a conversation is the sequence of its turns' numbers; texts are read once and never
shuffled. Conversations are dealt by ranges of their sequences and cut into shards of a bounded number of turns. A
shard packs its trie into BASE and CHECK arrays over turn numbers that are dense within the
shard, and all its conversations walk through them at once, turn by turn. As shards are ranges, only the
nodes on the way to a shard's first and last conversation can occur in another one. The rest is finished in the shard;
those nodes are merged by a digest of their sequence, and their subtrees are added up over the small tree that they form,
twice as deep in each round.

Conversations are rebuilt first: the first h turns of conversation c - c % 5 (the sign of c % 5 is
that of c), then c's own turns after its first h, with h = crc32(c in decimal) % 9.

Cases: null role or text is empty; a null turn number comes first; turns of equal number follow each other in the order
of their digests, so repeated rows are turns of their own, one behind the other; rows without conversation id
belong to no conversation and are left out; conversations that are rebuilt without turns end in the root; an empty table
has no conversation and no node. Ids must be whole numbers. A conversation's turn numbers are one row of eight bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.session import remove_path, scratch_path, ship

GROUP = 5
CUTS = 9
SHARD_TURNS = 1 << 18
#: Bytes of joined ids in one row.
PIECE_BYTES = 1 << 20
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a shard says of a node: finished ones have a row as in NODE, shared ones their part of it.
_PART = ("kind string, key binary, parent binary, size long, place long, piece binary, " + NODE)


def _number(turns: DataFrame, scratch: str) -> DataFrame:
    """(digest, bytes, turn_id): the distinct turns, densely numbered from 0 over all tasks."""
    spark = turns.sparkSession
    turns.groupBy("digest").agg(F.max("bytes").alias("bytes")).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"),
    ).write.parquet(f"{scratch}/turns")
    stored = spark.read.parquet(f"{scratch}/turns")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stored.groupBy("part").agg(F.count("*").alias("n"))  # a row for each task
    firsts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return stored.join(F.broadcast(firsts), "part").select("digest", "bytes", (F.col("first") + F.col("at")).alias("turn_id"))


def _digest(role: Column, text: Column) -> Column:
    """128 bits of a strong hash of role and text."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def rebuilt(conversations: DataFrame, scratch: str, group: int = GROUP, cuts: int = CUTS) -> DataFrame:
    """(conv_id, turns, sizes): every conversation as turn numbers, with the bytes of each text."""
    spark = conversations.sparkSession
    if not isinstance(conversations.schema["conv_id"].dataType, T.IntegralType):
        raise TypeError("conv_id must be a whole number")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), _digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    rows.write.parquet(f"{scratch}/rows")
    rows = spark.read.parquet(f"{scratch}/rows")
    numbered = rows.select("conv_id", "turn", "digest").join(_number(rows.select("digest", "bytes"), scratch), "digest")
    # null turns sort first; a digest decides between equal numbers
    turns = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "turn_id", "bytes"))).alias("turns"))
    turns.select(
        "conv_id", F.transform("turns", lambda t: t["turn_id"]).alias("turns"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"),
        F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(cuts)).cast("int").alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
    ).write.parquet(f"{scratch}/conversations")
    remove_path(spark, f"{scratch}/rows")
    remove_path(spark, f"{scratch}/turns")
    known = spark.read.parquet(f"{scratch}/conversations")
    heads = known.where(F.col("conv_id") == F.col("base")).select(
        "base", F.slice("turns", 1, cuts).alias("head"), F.slice("sizes", 1, cuts).alias("head_sizes"))

    def behind(head: str, own: str) -> Column:
        empty = F.array().cast("array<bigint>")
        own_rest = F.when(F.size(own) > F.col("h"), F.slice(own, F.col("h") + 1, F.size(own))).otherwise(empty)
        return F.concat(F.when(F.col(head).isNull() | (F.col("h") == 0), empty).otherwise(F.slice(head, F.lit(1), F.col("h"))), own_rest)

    return known.join(heads, "base", "left").select(
        "conv_id", behind("head", "turns").alias("turns"), behind("head_sizes", "sizes").alias("sizes"))


class DoubleArray:
    """A trie in BASE and CHECK arrays: node s has the child ``base[s] + code`` for a code if that one's check is s.

    Built from sorted distinct sequences of codes from 1 on; node 0 is the root.
    """

    def __init__(self, sequences: list[np.ndarray]) -> None:
        total = sum(map(len, sequences))
        codes = int(max((s.max() for s in sequences if len(s)), default=0))
        self.base = np.zeros(total + 1, np.int64)
        self.check = np.full(total + codes + 2, -1, np.int64)
        self.check[0] = 0
        self._free = 1
        # ranges of the sequences below a node, from the top downwards
        waiting = [(0, 0, len(sequences), 0)]
        while waiting:
            node, low, high, depth = waiting.pop()
            while low < high and len(sequences[low]) == depth:
                low += 1
            if low == high:
                continue
            first = [int(sequences[low][depth])]
            cuts = [low]
            if high - low > 1:
                column = np.array([s[depth] for s in sequences[low:high]])
                cuts = (np.flatnonzero(np.diff(column)) + 1 + low).tolist()
                first, cuts = [first[0], *(int(sequences[c][depth]) for c in cuts)], [low, *cuts]
            self._hold(node, self._fit(first), first)
            for code, start, end in zip(first, cuts, [*cuts[1:], high]):
                waiting.append((int(self.base[node]) + code, start, end, depth + 1))

    def _fit(self, codes: list[int]) -> int:
        """The first free place for children of these codes."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        place = self._free
        if len(codes) == 1:
            self._grow(place)
            return place - codes[0]
        apart = np.array(codes) - codes[0]
        while True:
            self._grow(place + int(apart[-1]))
            if (self.check[place + apart] < 0).all():
                return place - codes[0]
            place += 1

    def _grow(self, last: int) -> None:
        if last >= len(self.check):
            self.check = np.concatenate([self.check, np.full(last + len(self.check), -1, np.int64)])

    def _hold(self, node: int, base: int, codes: list[int]) -> None:
        if len(self.base) < len(self.check):
            self.base = np.concatenate([self.base, np.zeros(len(self.check) - len(self.base), np.int64)])
        self.base[node] = base
        self.check[base + np.array(codes)] = node

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of nodes by these codes."""
        found = self.base[nodes] + codes
        if not (self.check[found] == nodes).all():
            raise KeyError("no such child")
        return found


def _pieces(ids: list[int]) -> Iterator[bytes]:
    """Ids joined by commas, in parts of bounded size."""
    step = PIECE_BYTES // 21
    for at in range(0, len(ids), step):
        yield ",".join(map(str, ids[at:at + step])).encode()


def shard(ids: np.ndarray, turns: list[np.ndarray], sizes: list[np.ndarray], number: int) -> pa.RecordBatch:
    """The trie of some conversations, which are sorted by turns, then id: finished nodes and parts of shared ones."""
    count = len(ids)
    same = [False, *(len(a) == len(b) and bool((a == b).all()) for a, b in zip(turns, turns[1:]))]
    runs = [i for i in range(count) if not same[i]]  # the first of equal sequences
    ends = [*runs[1:], count]
    flat = np.concatenate([turns[i] for i in runs])
    known, dense = np.unique(flat, return_inverse=True)
    lengths = np.array([len(turns[i]) for i in runs])
    begin = np.cumsum(lengths) - lengths
    coded = [dense[b:b + n] + 1 for b, n in zip(begin.tolist(), lengths.tolist())]
    trie = DoubleArray(coded)
    places = len(trie.check)
    weight = np.diff([*runs, count])
    low = np.minimum.reduceat(ids, runs)
    n_convs, least, depth, size = np.zeros(places, np.int64), np.full(places, np.iinfo(np.int64).max), np.zeros(places, np.int64), np.zeros(places, np.int64)
    n_convs[0], least[0] = weight.sum(), low.min()
    # all sequences walk one turn further at a time
    at, alive = np.zeros(len(runs), np.int64), np.argsort(-lengths, kind="stable")
    paths = {0: [0], len(runs) - 1: [0]}
    sorted_lengths = -lengths[alive]
    run_first = np.array(runs)
    levels = [np.zeros(1, np.int64)]
    flat_sizes = np.concatenate([sizes[i] for i in runs])
    for turn in range(int(lengths.max(initial=0))):
        walking = alive[:int(np.searchsorted(sorted_lengths, -turn, "left"))]
        at[walking] = trie.step(at[walking], dense[begin[walking] + turn] + 1)
        here = at[walking]
        np.add.at(n_convs, here, weight[walking])
        np.minimum.at(least, here, low[walking])
        depth[here], size[here] = turn + 1, flat_sizes[begin[walking] + turn]
        levels.append(np.unique(here))
        for run, path in paths.items():
            if lengths[run] > turn:
                path.append(int(at[run]))
    nodes = np.concatenate(levels)
    parent = trie.check
    children, leaves, saved = np.zeros(places, np.int64), np.zeros(places, np.int64), np.zeros(places, np.int64)
    np.add.at(children, parent[nodes[1:]], 1)
    # the shared nodes, each with the digest of its sequence
    keys: dict[int, bytes] = {0: _ROOT}
    for run, path in paths.items():
        code = turns[run_first[run]].astype("<i8")
        for k, node in enumerate(path[1:]):
            keys.setdefault(node, hashlib.blake2b(keys[path[k]] + code[k].tobytes(), digest_size=16).digest())
    shared = np.zeros(places, bool)
    shared[list(keys)] = True
    own = nodes[~shared[nodes]]
    leaves[own] = children[own] == 0
    saved[own] = (n_convs[own] - 1) * size[own]
    inner = np.zeros(places, np.int64)  # children that are finished here
    for level in levels[:0:-1]:
        below = level[~shared[level]]
        np.add.at(leaves, parent[below], leaves[below])
        np.add.at(saved, parent[below], saved[below])
        np.add.at(inner, parent[below], 1)
    ended = dict(zip(at.tolist(), range(len(runs))))
    nothing = hashlib.sha256(b"").hexdigest()

    def digest(node: int) -> str:
        if node not in ended:
            return nothing
        found = hashlib.sha256()
        run = ended[node]
        for k, piece in enumerate(_pieces(ids[runs[run]:ends[run]].tolist())):
            found.update(b"," * (k > 0) + piece)
        return found.hexdigest()

    up = parent[own]
    above = [keys.get(int(p)) for p in up]
    columns = {
        "kind": ["node"] * len(own), "key": [None] * len(own), "parent": above, "size": size[own], "place": [None] * len(own), "piece": [None] * len(own),
        "conv_id": least[own], "depth": depth[own], "parent_conv_id": [None if a else int(least[p]) for a, p in zip(above, up.tolist())],
        "n_convs": n_convs[own], "n_children": children[own], "n_leaves": leaves[own], "saved_tokens": saved[own],
        "ends_sha256": [digest(n) for n in own.tolist()]}
    columns = {k: list(v) for k, v in columns.items()}

    def add(**values) -> None:
        for name, column in columns.items():
            column.append(values.get(name))

    for node, key in keys.items():
        add(kind="shared", key=key, parent=keys[int(parent[node])] if node else None, size=size[node], conv_id=least[node], depth=depth[node],
            n_convs=n_convs[node], n_children=inner[node], n_leaves=leaves[node], saved_tokens=saved[node])
        if node in ended:
            for k, piece in enumerate(_pieces(ids[runs[ended[node]]:ends[ended[node]]].tolist())):
                add(kind="ends", key=key, place=(number << 20) + k, piece=piece)
    return pa.RecordBatch.from_pydict(columns, schema=_arrow(_PART))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))])


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, turns, sizes, total = TaskContext.get().partitionId() << 20, [], [], [], 0
        for batch in batches:
            offsets = [batch.column(k).offsets.to_numpy() for k in (1, 2)]
            values = [batch.column(k).values.to_numpy(zero_copy_only=False) for k in (1, 2)]
            for row, conv in enumerate(batch.column(0).to_pylist()):
                found = [v[o[row]:o[row + 1]] for v, o in zip(values, offsets)]
                if ids and total + len(found[0]) + 1 > most:
                    yield shard(np.array(ids), turns, sizes, number)
                    number, ids, turns, sizes, total = number + 1, [], [], [], 0
                ids.append(conv)
                turns.append(found[0].astype(np.int64))
                sizes.append(found[1].astype(np.int64))
                total += len(found[0]) + 1
        if ids:
            yield shard(np.array(ids), turns, sizes, number)
    return run


def _joined_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash) of pieces that come sorted by key and place, without holding them together."""
    key, found = None, None
    for batch in batches:
        done = []
        for now, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if now != key:
                if key is not None:
                    done.append((key, found.hexdigest()))
                key, found = now, hashlib.sha256(piece)
            else:
                found.update(b"," + piece)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([found.hexdigest()])], ["key", "ends"])


def _subtrees(shared: DataFrame, scratch: str) -> DataFrame:
    """(key, n_leaves, saved_tokens) over whole subtrees, from those of each node alone.

    After k rounds a node holds the sums of all nodes less than 2 ** k below it and knows its
    ancestor 2 ** k above it.
    """
    spark, round_ = shared.sparkSession, 0
    known = shared.select("key", F.col("parent").alias("up"), "n_leaves", "saved_tokens")
    while True:
        path = f"{scratch}/subtrees-{round_}"
        known.write.parquet(path)
        if round_:
            remove_path(spark, f"{scratch}/subtrees-{round_ - 1}")
        known = spark.read.parquet(path)
        if known.where("up is not null").isEmpty():
            return known.drop("up")
        below = known.where("up is not null").groupBy(F.col("up").alias("key")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        further = known.select(F.col("key").alias("up"), F.col("up").alias("next"))
        known = known.join(below, "key", "left").join(further, "up", "left").select(
            "key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        round_ += 1


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, group: int = GROUP, cuts: int = CUTS) -> DataFrame:
    """Per node of the rebuilt conversations' trie: the columns of ``NODE``."""
    spark, scratch = ship(conversations.sparkSession), scratch_path(conversations.sparkSession, "prefixes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rebuilt(conversations, scratch, group, cuts)
    dealt = found.repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    dealt.mapInArrow(_shards(shard_turns), _PART).write.parquet(f"{scratch}/parts")
    remove_path(spark, f"{scratch}/conversations")
    stored = spark.read.parquet(f"{scratch}/parts")

    merged = stored.where("kind = 'shared'").groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    merged = merged.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    merged.drop("more").write.parquet(f"{scratch}/shared")
    shared = spark.read.parquet(f"{scratch}/shared")
    sums = _subtrees(shared.select(
        "key", "parent", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), scratch)

    pieces = stored.where("kind = 'ends'").select("key", "piece", "place").repartition(parts, "key").sortWithinPartitions("key", "place")
    ends = pieces.mapInArrow(_joined_hash, "key binary, ends string")
    above = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    upper = shared.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(above, "parent", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    lower = stored.where("kind = 'node'").join(above, "parent", "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    names = upper.columns
    return lower.select(names).union(upper.select(names))
