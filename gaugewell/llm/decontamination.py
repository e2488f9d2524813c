"""Documents that hold a benchmark item, up to edits, found by embedding edits into Hamming space.

A random walk embeds a sequence of words: it repeats the word it stands on at each step and
moves on if a random bit of (step, word) says so. Sequences within a small edit distance walk
together most of the time, so their embeddings agree in most places. Windows of the size of
an item and the items are embedded, some places of the embedding are sampled as a key, and
equal keys make a candidate; this is repeated with other walks and places until the target
recall at the allowed distance is reached, which is measured on edited copies of the items.
Each candidate is verified by its exact edit distance over words to the best passage of any length
in the window and as many words on both sides as edits are allowed.

Only windows that share enough word pairs with the items are embedded: e edits leave at least
n - 1 - 2e of the n - 1 pairs in a window over the passage or inside it, so the bound leaves none out.

Words are compared in lower case (A-Z) without marks at their ends. Items are a stated query set:
they are handled in blocks of bounded size, each against all documents.

Cases: null and empty texts and items match nothing; an item longer than the document is
compared with the whole document; repeated items each count; a document matches each item once; an
item of null id counts like any other and stands in item_ids as null, before the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugewell.llm.texts import LOWER, NO_LETTER, Words, mix, pieces, weights, text_or_empty, utf8
from gaugewell.session import ship

#: Edits allowed per word of the item: a similarity of 0.8.
EDIT_SHARE = 0.2
RECALL = 0.999
SAMPLED_PLACES = 3
#: Bytes of item text that one pass over the documents carries to each task.
BLOCK_BYTES = 8 << 20
#: Repeats are enough for the wanted recall where a walk finds its likes with this chance at least.
LEAST_CHANCE = 0.03
_FILTER_BITS = 18
#: Words of windows that a task holds before it looks at them.
_HELD_WORDS = 2 << 20
#: Bytes of text that a task holds while several blocks of items pass over them.
_HELD_BYTES = 32 << 20
#: Candidates whose distance is computed at once.
_PAIRS = 1 << 14
_ROW = np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: In a word, digits count as well as letters.
_SEPARATORS = NO_LETTER.copy()
_SEPARATORS[ord("0"):ord("9") + 1] = False


def names_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the compared words, and where those of each document begin."""
    words = Words(LOWER[data], offsets, _SEPARATORS)
    return words.names(), words.bounds


def _pairs(names: np.ndarray) -> np.ndarray:
    return mix(names[:-1] * np.uint64(31) + names[1:])


class Walks:
    """The repeated random walks for items of one length, with the places that make the keys."""

    def __init__(self, size: int, repeats: int, seed: int) -> None:
        draw = np.random.default_rng([seed, size])
        self.repeats = repeats
        self.salts = draw.integers(1, 1 << 63, repeats).astype(np.uint64)[:, None]
        places = draw.integers(0, 3 * size, (repeats, SAMPLED_PLACES))
        self.sampled = [np.flatnonzero((places == step).any(axis=1)) for step in range(int(places.max()) + 1)]
        #: One number per step and repeat, which with the word decides whether the walk moves on.
        self.turns = draw.integers(0, 1 << 63, (len(self.sampled), repeats, 1)).astype(np.uint64)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Keys of ``rows`` (word names, one window or item a row), one line per repeat."""
        count, size = rows.shape
        key = np.broadcast_to(self.salts, (self.repeats, count)).copy()
        # one more column stands for all that lies behind the end
        flat, base = np.append(rows, np.zeros((count, 1), np.uint64), axis=1).ravel(), np.arange(count) * (size + 1)
        at = np.broadcast_to(base, (self.repeats, count)).copy()
        for step, sampled in enumerate(self.sampled):
            if step > size:
                np.minimum(at, base + size, out=at)
            here = flat[at]
            if len(sampled):
                key[sampled] = mix(key[sampled] * np.uint64(31) + here[sampled])
            here ^= self.turns[step]
            here *= _STEP
            here >>= np.uint64(63)
            at += here.view(np.int64)
        return key


def edit_distances(a: np.ndarray, b: np.ndarray, free_ends: bool = False) -> np.ndarray:
    """Exact edit distance of each row of ``a`` to the same row of ``b``, or to its nearest passage with ``free_ends``."""
    kind = np.int16 if a.shape[1] + b.shape[1] < 1 << 14 else np.int64
    slope = np.arange(b.shape[1] + 1, dtype=kind)
    first = np.zeros_like(slope) if free_ends else slope
    row = np.broadcast_to(first, (len(a), b.shape[1] + 1)).copy()
    for i in range(a.shape[1]):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i, None] != b), out=best[:, 1:])
        # what insertions add along the row: the least of best[j] + (k - j)
        row = np.minimum.accumulate(best - slope, axis=1) + slope
    return row.min(axis=1) if free_ends else row[:, -1]


def _passage_distances(items: np.ndarray, texts: np.ndarray, item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Edit distance of each chosen item to the nearest passage of the text chosen beside it."""
    parts = [edit_distances(items[item[low:low + _PAIRS]], texts[text[low:low + _PAIRS]], free_ends=True)
             for low in range(0, len(item), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Items:
    """A block of items, grouped by length, with what the search for them needs."""

    def __init__(self, ids: list, texts: list[str], edit_share: float, recall: float, seed: int) -> None:
        names, bounds = names_of(*utf8(pa.array(texts, pa.string())))
        self.ids, self.share = ids, edit_share
        #: For each slot of word pairs the groups that hold such a pair, as bits; 64 lengths share them in turn.
        self.filter = np.zeros(1 << _FILTER_BITS, np.uint64)
        sizes = np.diff(bounds)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.uint64]] = []
        self.walks, self.keys = {}, {}
        #: The chance, by length, with which a passage at the allowed distance becomes a candidate.
        self.reached: dict[int, float] = {}
        for number, size in enumerate(np.unique(sizes[sizes > 0]).tolist()):
            which = np.flatnonzero(sizes == size)
            rows, bit = names[bounds[which][:, None] + np.arange(size)], np.uint64(1 << number % 64)
            self.groups.append((size, which, rows, bit))
            self.filter[self._slot(mix(rows[:, :-1] * np.uint64(31) + rows[:, 1:]).ravel())] |= bit
            self.walks[size] = Walks(size, self._repeats(size, rows, recall, seed), seed)
            keys = self.walks[size].keys(rows).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys[size] = keys[order], order % len(rows)

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def allowed(self, size: int) -> int:
        return int(self.share * size)

    def _repeats(self, size: int, rows: np.ndarray, recall: float, seed: int) -> int:
        """Repeats after which a passage at the allowed distance is found with the wanted chance.

        Measured on copies with as many edits as are allowed, half of them of each kind at random and half
        deletions only, which agree least, filled up with other words or cut off to the size of a window.
        """
        draw = np.random.default_rng([seed, size, 1])
        rows = rows[draw.integers(0, len(rows), 128)]
        edited = rows.copy()
        for r in range(len(edited)):
            words = edited[r].tolist()
            for _ in range(self.allowed(size)):
                at, kind = int(draw.integers(0, len(words))), int(draw.integers(0, 3)) if r % 2 else 2
                if kind == 0:
                    words[at] = int(draw.integers(1, 1 << 62))
                elif kind == 1:
                    words.insert(at, int(draw.integers(1, 1 << 62)))
                else:
                    words.pop(at)
                    words.append(int(draw.integers(1, 1 << 62)))
            edited[r] = words[:size]
        test = Walks(size, 64, seed + 1)
        same = (test.keys(rows) == test.keys(edited)).mean(axis=0)
        chance = float(np.quantile(same, 0.05))
        known = min(max(chance, LEAST_CHANCE), 0.99)
        repeats = max(4, int(np.ceil(np.log(1 - recall) / np.log(1 - known))))
        self.reached[size] = 1 - (1 - min(chance, 0.99)) ** repeats
        return repeats

    def matches(self, batch: pa.RecordBatch, text: str = "text") -> list[set[int]]:
        """For each document of the batch the positions of the items that it holds."""
        found: list[set[int]] = []
        windows: dict[int, list] = {size: [] for size, *_ in self.groups}
        for piece in pieces(batch, text):
            first = len(found)
            found.extend(set() for _ in range(piece.num_rows))
            self._windows(*utf8(piece.column(piece.schema.get_field_index(text))), first, found, windows)
            if sum(part[0].size for parts in windows.values() for part in parts) > _HELD_WORDS:
                self._look_at_all(windows, found)
        self._look_at_all(windows, found)
        return found

    def _look_at_all(self, windows, found) -> None:
        for size, which, rows, _ in self.groups:
            if windows[size]:
                self._look(size, which, rows, windows[size], found)
                windows[size] = []

    def _windows(self, data, offsets, first, found, windows) -> None:
        """The windows that share enough word pairs with the items of their size, each between the words around it."""
        names, bounds = names_of(data, offsets)
        if not len(names):
            return
        hit = self.filter[self._slot(_pairs(names))]
        inner = bounds[1:-1]
        hit[inner[(inner > 0) & (inner < len(names))] - 1] = 0  # across documents
        places = np.flatnonzero(hit)  # few: all that follows works on these
        hit, lengths = hit[places], np.diff(bounds)
        for size, which, rows, bit in self.groups:
            allowed = self.allowed(size)
            least = max(0, size - 1 - 2 * allowed)
            known = np.zeros(len(names) + 1, np.int32)
            known[places[(hit & bit) != 0] + 1] = 1
            np.cumsum(known, out=known)
            last = len(names) - size
            if last >= 0:
                starts = np.flatnonzero(known[size - 1:len(names)] - known[:last + 1] >= least)
                owner = np.searchsorted(bounds, starts, "right") - 1
                inside = starts + size <= bounds[owner + 1]
                starts, owner = starts[inside], owner[inside]
                if len(starts):
                    around = starts[:, None] + np.arange(-allowed, size + allowed)
                    own = (around >= bounds[owner][:, None]) & (around < bounds[owner + 1][:, None])
                    # 0 stands for all that lies outside the document
                    around = np.where(own, names[np.clip(around, 0, len(names) - 1)], np.uint64(0))
                    windows[size].append((around, owner + first))
            # a document shorter than the item stands for its window
            for document in np.flatnonzero((lengths < size) & (lengths >= max(1, size - allowed))).tolist():
                low, high = bounds[document], bounds[document + 1]
                if known[high - 1] - known[low] >= (high - low) - 1 - 2 * allowed:
                    whole = np.broadcast_to(names[low:high], (len(rows), high - low))
                    near = edit_distances(rows, whole, free_ends=True) <= allowed
                    found[first + document].update(which[near].tolist())

    def _look(self, size, which, rows, parts, found) -> None:
        """Candidates by equal keys, then the exact distance; equal windows are looked at once.

        A passage sticks out of its window by as many words as edits are allowed at most, so a window
        within twice that distance is decided with the words around it, where they differ.
        """
        around, owner = (np.concatenate(p) for p in zip(*parts))
        allowed = self.allowed(size)
        windows = around[:, allowed:allowed + size]
        _, at, back = np.unique(mix(windows * weights(int(_ROW), size)).sum(axis=1), return_index=True, return_inverse=True)
        windows = windows[at]
        item_keys, items = self.keys[size]
        pairs = []
        for low in range(0, len(windows), 2048):
            own = self.walks[size].keys(windows[low:low + 2048])
            left, right = np.searchsorted(item_keys, own, "left").ravel(), np.searchsorted(item_keys, own, "right").ravel()
            count = right - left
            window = np.repeat(np.arange(len(count)) % own.shape[1] + low, count)
            item = items[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)]
            pairs.append(np.unique(window * len(rows) + item))
        pairs = np.concatenate(pairs)
        window, item = pairs // len(rows), pairs % len(rows)
        distance = _passage_distances(rows, windows, item, window)
        near = distance <= allowed
        matched: dict[int, list[int]] = {}
        for w, i in zip(window[near].tolist(), which[item[near]].tolist()):
            matched.setdefault(w, []).append(i)
        for document, w in zip(owner.tolist(), back.tolist()):
            if w in matched:
                found[document].update(matched[w])
        open_ = (distance > allowed) & (distance <= 2 * allowed)
        window, item = window[open_], item[open_]
        # each place of such a window
        places, count = np.argsort(back, kind="stable"), np.bincount(back, minlength=len(windows))
        begin, count = (np.cumsum(count) - count)[window], count[window]
        place = places[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
        item = np.repeat(item, count)
        left_open = np.array([i not in found[d] for d, i in zip(owner[place].tolist(), which[item].tolist())], bool)
        place, item = place[left_open], item[left_open]
        name = mix(around[place] * weights(int(_ROW), around.shape[1])).sum(axis=1)
        _, at, back = np.unique(mix(name) + item.astype(np.uint64), return_index=True, return_inverse=True)
        near = (_passage_distances(rows, around, item[at], place[at]) <= allowed)[back]
        for document, i in zip(owner[place[near]].tolist(), which[item[near]].tolist()):
            found[document].add(i)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of at most ``most`` bytes, one block at a time on the driver."""
    kind = "long" if isinstance(benchmark.schema[item_col].dataType, T.IntegralType) else "string"
    rows = benchmark.select(F.col(item_col).cast(kind).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        ids.append(row["id"])
        texts.append(row["text"])
        size += len(row["text"].encode())
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _taken(block: Broadcast, alone: bool) -> tuple[Items, int]:
    """The items of a block and the number of its first; the worker keeps them if it is the only block."""
    value = block.value
    if not alone:
        vars(block).pop("_value", None)
    return value


def _search(blocks: list[Broadcast], kind: pa.DataType):
    """Each row's items, by id and number in the benchmark, before its other columns."""
    item = pa.struct([("id", kind), ("number", pa.int64())])

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[[] for _ in range(batch.num_rows)] for batch in held]
        for block in blocks:
            items, first = _taken(block, len(blocks) == 1)
            for batch, lists in zip(held, found):
                for into, matches in zip(lists, items.matches(batch, "__text")):
                    into.extend((items.ids[i], first + i) for i in matches)
        for batch, lists in zip(held, found):
            lists = [sorted(f, key=lambda m: (m[0] is not None, m[0] if m[0] is not None else 0, m[1])) for f in lists]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(item)), *batch.columns[1:]], ["items", *batch.schema.names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(0).nbytes
            if len(blocks) == 1 or size >= _HELD_BYTES:
                yield from judged(held)
                held, size = [], 0
        yield from judged(held)
    return run


def _judged(docs: DataFrame, columns: list[str], text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str,
            block_bytes: int, *options) -> DataFrame:
    """``items`` of each row, and the asked columns as c0, c1, ...: one scan, whatever the number of blocks."""
    spark, blocks, first = ship(docs.sparkSession), [], 0
    for ids, texts in _blocks(benchmark, item_col, item_text_col, block_bytes):
        # the driver keeps a handle
        blocks.append(spark.sparkContext.broadcast((Items(ids, texts, *options), first)))
        first += len(ids)
    whole = isinstance(benchmark.schema[item_col].dataType, T.IntegralType)
    named = docs.toDF(*(f"__d{i}" for i in range(len(docs.columns))))
    place = {c: f"__d{i}" for i, c in enumerate(docs.columns)}
    given = named.select(text_or_empty(F.col(place[text_col])).alias("__text"), *(F.col(place[c]).alias(f"c{i}") for i, c in enumerate(columns)))
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in given.schema[1:])
    return given.mapInArrow(
        _search(blocks, pa.int64() if whole else pa.string()), f"items array<struct<id: {'long' if whole else 'string'}, number: long>>{kinds}")


def contamination(
    docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, recall: float = RECALL, seed: int = 17,
    block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per row: id, contaminated, n_items, item_ids (sorted, null first) of the items it holds."""
    found = _judged(docs, [id_col], text_col, benchmark, item_col, item_text_col, block_bytes, edit_share, recall, seed)
    return found.select(
        F.col("c0").alias(id_col), (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"), F.col("items.id").alias("item_ids"))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, recall: float = RECALL, seed: int = 17,
    block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that hold no item of the benchmark."""
    found = _judged(docs, docs.columns, text_col, benchmark, item_col, item_text_col, block_bytes, edit_share, recall, seed)
    return found.where(F.size("items") == 0).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def expected_recall(
    benchmark: DataFrame, edit_share: float = EDIT_SHARE, recall: float = RECALL, seed: int = 17, block_bytes: int = BLOCK_BYTES,
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(words, recall): for each length of items the least chance that a passage with all allowed edits is found."""
    found: dict[int, float] = {}
    for ids, texts in _blocks(benchmark, item_col, item_text_col, block_bytes):
        for size, reached in Items(ids, texts, edit_share, recall, seed).reached.items():
            found[size] = min(reached, found.get(size, 1.0))
    return benchmark.sparkSession.createDataFrame(sorted(found.items()), "words long, recall double")
