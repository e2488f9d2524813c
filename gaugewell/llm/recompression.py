"""Removal of long passages that occur more than once, found by recompression.

Rounds replace runs of equal symbols and pairs of neighbouring symbols by new symbols.
A name depends only on what it stands for, so all tasks give equal pieces the same name,
and each symbol carries the range of words that decided how it was formed. Whatever
repeats a window that holds this range repeats the symbol too. So a symbol that occurs
once in the whole corpus rules out all windows around its range, and only the windows
left are verified, by a cryptographic digest of their words. Names are quick hashes: words that share
one can leave a window to be verified, but never remove or keep one.

The texts cross one shuffle, compressed and once per distinct text and task, into blocks of
bounded size. Symbols and windows are stored as one row per block and name, so that a passage
held by a third of all documents costs each block one row; they are added up before a shuffle, and the join
that brings the totals back can split a name of many blocks.

Cases: null text has no words; equal texts are one text with several copies; a text shorter
than a window keeps its words; repeated rows count as copies and each gets a result row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gaugewell.llm.texts import Words, mix, pieces, text_or_empty
from gaugewell.session import remove_path, scratch_path, ship

WINDOW = 35
ROUNDS = 5
#: Symbols of fewer words are too common to rule out a window and are not counted.
COUNTED_WORDS = 4
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Symbols:
    """Symbols over the words of some documents; round by round there are fewer."""

    def __init__(self, names: np.ndarray, bounds: np.ndarray) -> None:
        count = len(names)
        self.name = names
        self.document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.before = bounds[:-1][self.document] - 1  # beyond the document: never inside a window
        self.behind = bounds[1:][self.document] + 1
        self.words = np.ones(count, np.int64)
        self.low = np.arange(count)  # the words low .. high - 1 decided on this symbol
        self.high = self.low + 1

    def _next(self, values: np.ndarray, at: np.ndarray, step: int, else_: np.ndarray) -> np.ndarray:
        """``values`` of the neighbours of ``at`` in the same document, else ``else_``."""
        other = np.clip(at + step, 0, len(self.name) - 1)
        same = (other != at) & (self.document[other] == self.document[at])
        return np.where(same, values[other], else_)

    def _take(self, at, name, words, low, high) -> None:
        self.name, self.words, self.low, self.high = name, words, low, high
        self.document, self.before, self.behind = self.document[at], self.before[at], self.behind[at]

    def name_runs(self) -> None:
        """A run of equal symbols becomes one symbol; its neighbours decided where it ends."""
        if not len(self.name):
            return
        goes_on = np.zeros(len(self.name), bool)
        goes_on[1:] = (self.name[1:] == self.name[:-1]) & (self.document[1:] == self.document[:-1])
        head = np.flatnonzero(~goes_on)
        count = np.diff(np.append(head, len(self.name)))
        tail = head + count - 1
        low = np.minimum(self.low[head], self._next(self.low, head, -1, self.before[head]))
        high = np.maximum(self.high[tail], self._next(self.high, tail, 1, self.behind[tail]))
        run = mix(self.name[head] * np.uint64(31) + count.astype(np.uint64))
        self._take(head, np.where(count > 1, run, self.name[head]), np.add.reduceat(self.words, head), low, high)

    def name_pairs(self, round_: int) -> None:
        """Each symbol is a left or a right one; a left one and the right one behind it pair."""
        if not len(self.name):
            return
        left = (mix(self.name + np.uint64(round_ * 7919 + 13)) & np.uint64(1)) == 1
        pairs = np.zeros(len(self.name), bool)
        pairs[:-1] = left[:-1] & ~left[1:] & (self.document[:-1] == self.document[1:])
        stays = np.ones(len(self.name), bool)
        stays[1:] = ~pairs[:-1]
        at = np.flatnonzero(stays)
        paired, second = pairs[at], np.minimum(at + 1, len(self.name) - 1)
        # a left symbol depends on what is behind it, a right one on what is before it
        high = np.where(left[at], self._next(self.high, at, 1, self.behind[at]), self.high[at])
        low = np.where(~left[at], self._next(self.low, at, -1, self.before[at]), self.low[at])
        pair = mix(self.name[at] * _ODD + mix(self.name[second] + np.uint64(round_)))
        self._take(
            at, np.where(paired, pair, self.name[at]), self.words[at] + np.where(paired, self.words[second], 0),
            np.minimum(low, self.low[at]), np.maximum(high, self.high[at]),
        )


def parse(names: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    symbols = Symbols(names, bounds)
    symbols.name_runs()
    for round_ in range(rounds):
        symbols.name_pairs(round_)
    return symbols


def window_digests(words: Words, starts: np.ndarray, window: int) -> np.ndarray:
    """128 bits of a cryptographic hash of the words of each window, joined by a space."""
    # all words behind one another, a space after each
    size = words.ends - words.starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(at[-1], 0x20, np.uint8)
    joined[~_marks(at[1:] - 1, int(at[-1]))] = words.data[words.inside]
    text, blake = joined.tobytes(), hashlib.blake2b
    found = b"".join([blake(text[low:high], digest_size=16).digest() for low, high in zip(at[starts].tolist(), (at[starts + window] - 1).tolist())])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)


def _marks(places: np.ndarray, count: int) -> np.ndarray:
    marks = np.zeros(count, bool)
    marks[places] = True
    return marks


class Piece:
    """Some texts of a block, parsed; ``counted`` are the symbols that can rule out windows."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.texts, self.window = texts, window
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        symbols = parse(self.words.names(), self.words.bounds)
        counted = (symbols.words >= COUNTED_WORDS) & (symbols.high - symbols.low <= window)
        self.names, self.low, self.high = symbols.name[counted], symbols.low[counted], symbols.high[counted]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """First words of the windows that no symbol with a single occurrence rules out."""
        count, window, bounds = len(self.words), self.window, self.words.bounds
        if count < window:
            return np.zeros(0, np.int64)
        change = np.zeros(count + 1, np.int64)
        low, high = self.low[~shared], self.high[~shared]
        np.add.at(change, np.maximum(high - window, 0), 1)
        np.add.at(change, low + 1, -1)
        possible = np.cumsum(change)[:count] == 0
        # none that leaves its document
        ends = np.repeat(bounds[1:], np.diff(bounds))
        return np.flatnonzero(possible & (np.arange(count) + window <= ends))


class Block:
    """The distinct texts of a block in the order of their digests, so that numbering repeats."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        copies: dict[str, int] = {}
        packed: dict[str, bytes] = {}
        for digest, count, text in zip(*(rows.column(c).to_pylist() for c in ("digest", "copies", "packed"))):
            copies[digest] = copies.get(digest, 0) + count
            packed[digest] = text
        self.digests = sorted(packed)
        self.copies = [copies[d] for d in self.digests]
        unpack = zstandard.ZstdDecompressor().decompress
        self.pieces: list[Piece] = []
        texts: list[bytes] = []
        size = 0
        for digest in self.digests:
            texts.append(unpack(packed[digest]))
            size += len(texts[-1])
            if size >= PIECE_BYTES:
                self.pieces.append(Piece(texts, window))
                texts, size = [], 0
        if texts:
            self.pieces.append(Piece(texts, window))
        names = [p.names for p in self.pieces]
        self.names, self.where, self.counts = np.unique(
            np.concatenate(names) if names else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)

    def windows(self, shared: np.ndarray) -> None:
        """Find the candidate windows, numbered by their sorted digests."""
        known = np.zeros(len(self.names), bool)
        known[shared] = True
        flags, at, self.starts, high, low = known[self.where], 0, [], [], []
        for piece in self.pieces:
            self.starts.append(piece.candidates(flags[at:at + len(piece.names)]))
            at += len(piece.names)
            if len(self.starts[-1]):
                digests = window_digests(piece.words, self.starts[-1], piece.window)
                high.append(digests[:, 0])
                low.append(digests[:, 1])
        high = np.concatenate(high) if high else np.zeros(0, np.uint64)
        low = np.concatenate(low) if low else np.zeros(0, np.uint64)
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.high, self.low = high[order][heads], low[order][heads]
        self.repeats = np.diff(np.append(heads, len(order)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a batch once, compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for piece in pieces(batch, "text", BLOCK_BYTES):
            rows: dict[str, list] = {}
            digests, texts = piece.column(0).to_pylist(), piece.column(1)
            for i, digest in enumerate(digests):
                if digest in rows:
                    rows[digest][1] += 1
                else:
                    rows[digest] = [digest, 1, pack(texts[i].as_buffer())]
            names, copies, packed = zip(*rows.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(copies, pa.int64()), pa.array(packed, pa.binary())],
                ["digest", "copies", "packed"])


def _columns(schema: str, *values) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(v, kinds[k]) for (n, k), v in zip(fields, values)})


_SYMBOLS = "name long, block int, number int, n int"
_WINDOWS = "high long, low long, block int, number int, n int"
_RESULTS = "digest string, n_words long, n_removed long, kept_sha256 string"


def _count_symbols(window: int):
    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows, window)
        count = len(block.names)
        return _columns(_SYMBOLS, block.names.view(np.int64), np.full(count, rows.column("block")[0].as_py()),
                        np.arange(count), block.counts)
    return run


def _numbers(side: pa.Table, kind: int) -> np.ndarray:
    if not side.num_rows:
        return np.zeros(0, np.int64)
    return side.column("number").to_numpy()[side.column("kind").to_numpy() == kind]


def _count_windows(window: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _columns(_WINDOWS, *[[]] * 5)
        block = Block(rows, window)
        block.windows(_numbers(side, 0))
        count = len(block.high)
        return _columns(_WINDOWS, block.high.view(np.int64), block.low.view(np.int64),
                        np.full(count, rows.column("block")[0].as_py()), np.arange(count), block.repeats)
    return run


def _remove(window: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if not rows.num_rows:
            return _columns(_RESULTS, *out)
        block = Block(rows, window)
        block.windows(_numbers(side, 0))
        repeated = np.zeros(len(block.high), bool)
        repeated[_numbers(side, 1)] = True
        flags, at, row = repeated[block.number], 0, 0
        for piece, starts in zip(block.pieces, block.starts):
            change = np.zeros(len(piece.words) + 1, np.int64)
            hit = starts[flags[at:at + len(starts)]]
            at += len(starts)
            change[hit] += 1
            np.add.at(change, hit + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            for text, low, high in zip(piece.texts, piece.words.bounds[:-1].tolist(), piece.words.bounds[1:].tolist()):
                removed = int(gone[low:high].sum())
                kept = text.split()
                if block.copies[row] > 1 and high - low >= window:
                    removed, kept = high - low, []
                elif removed:
                    kept = [w for w, g in zip(kept, gone[low:high].tolist()) if not g]
                for column, value in zip(out, (block.digests[row], high - low, removed,
                                               hashlib.sha256(b" ".join(kept)).hexdigest())):
                    column.append(value)
                row += 1
        return _columns(_RESULTS, *out)
    return run


def _repeated(rows: DataFrame, key: list[str], kind: int) -> DataFrame:
    """(block, number, kind) of the stored rows whose key occurs more than once over all blocks."""
    often = rows.groupBy(*key).agg(F.sum("n").alias("total")).where("total > 1").select(*key)
    return rows.join(often, key).select("block", "number", F.lit(kind).alias("kind"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 of the words that stay.

    A word goes if a window of ``window`` words that covers it also begins elsewhere.
    """
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias("text"))
    texts = texts.withColumn("digest", F.sha2("text", 256))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    packed = (
        texts.select("digest", "text")
        .mapInArrow(_pack, "digest string, copies long, packed binary")
        .withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))
        .repartition(partitions, "block")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    scratch = scratch_path(spark, "recompression")

    packed.groupBy("block").applyInArrow(_count_symbols(window), _SYMBOLS).write.parquet(f"{scratch}/names")
    _repeated(spark.read.parquet(f"{scratch}/names"), ["name"], 0).write.parquet(f"{scratch}/symbols")
    remove_path(spark, f"{scratch}/names")
    shared = spark.read.parquet(f"{scratch}/symbols")
    packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_count_windows(window), _WINDOWS).write.parquet(f"{scratch}/windows")
    repeated = _repeated(spark.read.parquet(f"{scratch}/windows"), ["high", "low"], 1)
    side = shared.unionByName(repeated)
    (
        packed.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(_remove(window), _RESULTS)
        .write.parquet(f"{scratch}/results")
    )
    packed.unpersist()
    for done in ("symbols", "windows"):
        remove_path(spark, f"{scratch}/{done}")
    results = spark.read.parquet(f"{scratch}/results")
    return (
        texts.select(id_col, "digest").join(results, "digest")
        .select(id_col, "n_words", "n_removed", "kept_sha256")
    )
