"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters are dealt into groups of about equal weight. A word becomes the vector of its
counts in these groups, and the trie has one level for each group. One inserted, deleted or replaced
letter adds at most one to a single group and takes at most one from another, so
a depth-first search that may spend one surplus and one deficit meets every near word; the words of
the leaves it reaches are then verified letter by letter.

The trie is cut where its branches hold a bounded number of words. Only the part above the cut, a few
numbers for each branch, is on the driver; each branch is searched in a task of its own by its words and by those words of
earlier branches that can reach it, so that every pair of words meets once. A task returns one row for each
word it found near ones for, never the pairs.

Cases: null and empty texts have no words; a document without id changes no word; repeated rows count
again, each with all its words; letters beyond the range end a word; words of any length are compared whole; no
documents give no rows. Of equally frequent near words the smallest in code-point order is the form. A
leaf, whose words hold the same letters in another order or letters of the same groups, is not split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.texts import LOWER, pieces, text_or_empty, utf8
from gaugewell.session import remove_path, scratch_path, ship

LEAST_LETTERS = 5
LEAST_COUNT = 3
#: One run in so many loses a letter.
DAMAGED = 97
GROUPS = 16
BRANCH_WORDS = 1 << 15
PIECE_BYTES = 4 << 20
_LEAD = 0xC3  # in UTF-8 the first byte of U+00C0 to U+00FF, and of nothing else
_PAIRS_AT_ONCE = 1 << 17
_LONG = 64

_ASCII = np.zeros(256, bool)
_ASCII[ord("A"):ord("Z") + 1] = _ASCII[ord("a"):ord("z") + 1] = True


def _crc_steps() -> np.ndarray:
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> np.uint32(1)) ^ np.where(steps & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return steps


_CRC = _crc_steps()


def crc32(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte runs, each carried on from the CRC-32 in ``before``."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, state = starts[order], lengths[order], ~before[order].astype(np.uint32)
    long = int(np.searchsorted(-lengths, -_LONG, "left"))
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(data[starts[i]:starts[i] + lengths[i]].tobytes(), int(~state[i])))
    for at in range(int(lengths[long:].max(initial=0))):
        end = int(np.searchsorted(-lengths, -at, "left"))
        now = state[long:end]
        state[long:end] = _CRC[(now ^ data[starts[long:end] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
    result = np.empty_like(state)
    result[order] = ~state
    return result


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, offsets: np.ndarray, ids: list) -> pa.Array:
    """All words of some documents, after the damage, as often as they occur."""
    lead = data == _LEAD
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = letter[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.large_string())
    packed, place = LOWER[data[letter]], np.cumsum(letter)
    begin = place[starts] - 1
    size = np.diff(np.append(begin, len(packed)))
    leads = np.concatenate([[0], np.cumsum(packed == _LEAD)])
    letters = size - (leads[begin + size] - leads[begin])
    enough = np.flatnonzero(letters >= LEAST_LETTERS)
    begin, size, letters = begin[enough], size[enough], letters[enough]
    document = np.searchsorted(offsets, starts[enough], "right") - 1
    known = np.array([i is not None for i in ids], bool)
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = crc32(packed, begin, size, before[document])
    damaged = (crc % np.uint32(DAMAGED) == 0) & known[document]
    left = []
    for i in np.flatnonzero(damaged).tolist():
        if letters[i] > LEAST_LETTERS:
            word, at = packed[begin[i]:begin[i] + size[i]].tobytes().decode(), int(crc[i]) % int(letters[i])
            left.append(word[:at] + word[at + 1:])
    # the bytes of whole words, one behind another
    whole = ~damaged
    border = np.zeros(len(packed) + 1, np.int8)
    np.add.at(border, begin[whole], 1)
    np.add.at(border, begin[whole] + size[whole], -1)
    found = _binary(packed[np.cumsum(border[:-1]).astype(bool)], size[whole])
    return pa.concat_arrays([found, pa.array(left, pa.large_string())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, most=PIECE_BYTES):
            counts = words(*utf8(piece.column(1)), piece.column(0).to_pylist()).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of enough letters that occur often enough, with their number of occurrences."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    found = given.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= LEAST_COUNT)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, all below 256, and one offset for each word."""
    data, offsets = utf8(column)
    lead = data == _LEAD
    after = np.concatenate([[False], lead[:-1]])[:len(data)]
    points = np.where(after, data + np.uint8(0x40), data)[~lead]
    return points, offsets - np.concatenate([[0], np.cumsum(lead)])[offsets]


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(_letters(batch.column(0))[0], minlength=256)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["letter", "n"])


def letter_groups(vocabulary: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The group of each of 256 code points: the next most frequent letter joins the lightest group."""
    weights = vocabulary.select("word").mapInArrow(_weights, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    found = np.zeros(256, np.int64)
    load = [0] * groups
    for row in sorted(weights.collect(), key=lambda r: (-r["n"], r["letter"])):  # at most 256 rows
        lightest = min(range(groups), key=lambda g: (load[g], g))
        found[row["letter"]] = lightest
        load[lightest] += row["n"]
    return found


def vectors(points: np.ndarray, offsets: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Counts by group of each word, 255 standing for all above: a difference of one stays one or becomes none."""
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    counts = np.bincount(word * groups + group[points], minlength=(len(offsets) - 1) * groups)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, groups)


class Trie:
    """A trie over equally or unequally long vectors in sorted order, level by level.

    ``keys[l]`` has parent * 256 + count of each node of level l + 1, ascending;
    ``ends[l]`` the vector that ends in the node, or -1.
    """

    def __init__(self, found: list[bytes]) -> None:
        self.keys, self.ends = [], []
        level, depth = {b"": 0}, 0
        while True:
            below = sorted({v[:depth + 1] for v in found if len(v) > depth})
            if not below:
                break
            self.keys.append(np.array([level[v[:-1]] * 256 + v[-1] for v in below], np.int64))
            level, depth = {v: i for i, v in enumerate(below)}, depth + 1
            ends = np.full(len(below), -1, np.int64)
            for i, v in enumerate(found):
                if len(v) == depth:
                    ends[level[v]] = i
            self.ends.append(ends)

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Trie:
        """Of distinct sorted rows, which all end on the last level."""
        trie = cls([])
        count, width = rows.shape
        new = np.ones(count, bool)
        new[1:] = False
        parent = np.zeros(count, np.int64)
        for level in range(width):
            new[1:] |= rows[1:, level] != rows[:-1, level]
            trie.keys.append((parent * 256 + rows[:, level])[new])
            parent = np.cumsum(new) - 1
            trie.ends.append(np.full(int(parent[-1]) + 1, -1) if level + 1 < width else np.arange(count))
        return trie


def search(trie: Trie, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked row, vector of the trie) that differ by at most one surplus and one deficit.

    Depth first: the stack holds parts of bounded size, each a level with asked rows, nodes and what is spent.
    """
    rows = np.arange(len(asked))
    stack = [(0, rows[at:at + _PAIRS_AT_ONCE], np.zeros(len(rows[at:at + _PAIRS_AT_ONCE]), np.int64), None)
             for at in range(0, len(rows), _PAIRS_AT_ONCE)]
    while stack:
        level, row, node, spent = stack.pop()
        if level == len(trie.keys) or not len(row):
            continue
        if spent is None:
            spent = np.zeros(len(row), np.int8)
        keys, wanted = trie.keys[level], node * 256 + asked[row, level]
        at = np.searchsorted(keys, wanted)
        parts = []
        after = at + (keys[np.minimum(at, len(keys) - 1)] == wanted)
        for change, cost, place in ((0, 0, at), (1, 1, after), (-1, 2, at - 1)):
            inside = np.clip(place, 0, len(keys) - 1)
            fits = (keys[inside] == wanted + change) & (keys[inside] >> 8 == node) & (spent & cost == 0)
            if fits.any():
                parts.append((row[fits], inside[fits], spent[fits] | np.int8(cost)))
        if not parts:
            continue
        row, node, spent = (np.concatenate(p) for p in zip(*parts))
        end = trie.ends[level][node]
        over = end >= 0
        if over.any():
            yield row[over], end[over]
            row, node, spent = row[~over], node[~over], spent[~over]
        for first in range(0, len(row), _PAIRS_AT_ONCE):
            part = slice(first, first + _PAIRS_AT_ONCE)
            stack.append((level + 1, row[part], node[part], spent[part]))


class _Near:
    """The words of a branch, and whether two of them are exactly one edit apart."""

    def __init__(self, points: np.ndarray, offsets: np.ndarray) -> None:
        self.points, self.starts, self.size = points, offsets[:-1], np.diff(offsets)
        self.width = int(min(self.size.max(initial=1), _LONG))
        column = np.arange(self.width)
        at = self.starts[:, None] + column
        self.left = np.where(column < self.size[:, None], points[np.minimum(at, len(points) - 1)], 0)
        at = offsets[1:, None] - 1 - column
        self.right = np.where(column < self.size[:, None], points[np.maximum(at, 0)], 0)
        self.head = self.left[:, 0].astype(np.int32) << 8 | self.left[:, 1]
        self.tail = self.right[:, 0].astype(np.int32) << 8 | self.right[:, 1]

    def keep(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A mask of the pairs that are one edit apart; an edit leaves two letters at one end as they are."""
        kept = (self.head[i] == self.head[j]) | (self.tail[i] == self.tail[j])
        kept &= (np.abs(self.size[i] - self.size[j]) <= 1) & (i != j)
        there = np.flatnonzero(kept)
        a, b = i[there], j[there]
        short, longer = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        same = [np.argmin(np.concatenate([side[a] == side[b], np.zeros((len(a), 1), bool)], axis=1), axis=1) for side in (self.left, self.right)]
        near = np.minimum(same[0], short) + np.minimum(same[1], short) >= longer - 1
        for k in np.flatnonzero(longer > self.width).tolist():
            near[k] = self._long(int(a[k]), int(b[k]))
        kept[there] = near
        return kept

    def _long(self, i: int, j: int) -> bool:
        x, y = (self.points[self.starts[k]:self.starts[k] + self.size[k]] for k in (i, j))
        if len(x) > len(y):
            x, y = y, x
        differ = np.flatnonzero(x != y[:len(x)])
        at = int(differ[0]) if len(differ) else len(x)
        return np.array_equal(x[at + 1:], y[at + 1:]) if len(x) == len(y) else np.array_equal(x[at:], y[at + 1:])


def _products(left: np.ndarray, lefts: np.ndarray, right: np.ndarray, rights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the k-th left and the k-th right range (first place, size), a bounded number at a time."""
    ends = np.cumsum(lefts * rights)
    for at in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS_AT_ONCE):
        number = np.arange(at, min(at + _PAIRS_AT_ONCE, int(ends[-1])))
        which = np.searchsorted(ends, number, "right")
        inner = number - (ends[which] - lefts[which] * rights[which])
        yield left[which] + inner // rights[which], right[which] + inner % rights[which]


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where the runs of equal neighbouring rows begin, and the end of the last."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return np.append(np.flatnonzero(new), len(rows))


def near_in_branch(column: pa.Array, n: np.ndarray, own: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """(word, near words, the best of them) for the words of a branch and those that ask it."""
    points, offsets = _letters(column)
    counts = vectors(points, offsets, group, groups)
    order = np.lexsort([*counts.T[::-1], ~own])  # by vector, the words of the branch first
    counts, mine = counts[order], int(own.sum())
    near = _Near(points, offsets)
    first = _starts(counts[:mine])
    begin = np.concatenate([first, mine + _starts(counts[mine:])[1:]])
    leaves, sizes = len(first) - 1, np.diff(begin)
    leaf_of = np.repeat(np.arange(len(sizes)), sizes)
    by_word = np.argsort(np.array(column.cast(pa.binary()).to_pylist(), object), kind="stable")
    alphabet = np.empty(len(column), np.int64)
    alphabet[by_word] = np.arange(len(column))
    by_rank = np.lexsort([alphabet, -n])  # most frequent first, then in code-point order
    rank = np.empty(len(column), np.int64)
    rank[by_rank] = np.arange(len(column))
    total, best = np.zeros(len(column), np.int64), np.full(len(column), len(column))
    for asker, leaf in search(Trie.of_rows(counts[first[:-1]]), counts[begin[:-1]]):
        once = (asker >= leaves) | (asker <= leaf)
        asker, leaf = asker[once], leaf[once]
        for i, j in _products(begin[asker], sizes[asker], begin[leaf], sizes[leaf]):
            twice = (leaf_of[i] == leaf_of[j]) & (i >= j)  # inside a leaf each pair comes in both orders
            i, j = order[i[~twice]], order[j[~twice]]
            kept = near.keep(i, j)
            i, j = i[kept], j[kept]
            for x, y in ((i, j), (j, i)):
                total += np.bincount(x, minlength=len(total))
                np.minimum.at(best, x, rank[y])
    found = np.flatnonzero(total)
    return found, total[found], by_rank[best[found]]


def _cut(vocabulary: DataFrame, groups: int, most: int) -> list[bytes]:
    """The branches: shortest vectors that begin those of at most ``most`` words, or whole vectors."""
    branches, large, level = [], [b""], 0
    rows = vocabulary.agg(F.count("*")).first()[0]
    if rows <= most:
        return [b""]
    while large and level < groups:
        level += 1
        begin = F.substring("vector", 1, level)
        # branches of a bounded size, so their number is bounded by that of the words
        above = F.substring("vector", 1, level - 1).isin([bytearray(v) for v in large]) if level > 1 else F.lit(True)
        found = vocabulary.where(above).groupBy(begin.alias("begin")).agg(F.count("*").alias("n")).collect()
        whole = level == groups
        large = [bytes(r["begin"]) for r in found if r["n"] > most and not whole]
        branches += [bytes(r["begin"]) for r in found if r["n"] <= most or whole]
    return sorted(branches)


def _with_vectors(group: np.ndarray, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors(*_letters(batch.column(0)), group, groups)
            vector = pa.Array.from_buffers(pa.binary(groups), len(counts), [None, pa.py_buffer(counts)])
            yield pa.RecordBatch.from_arrays([*batch.columns, vector.cast(pa.binary())], ["word", "n", "vector"])
    return run


def _ask(branches: list[bytes], group: np.ndarray, groups: int):
    """Each word for its own branch, and for later ones in which a near word can be."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(branches)
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = vectors(*_letters(batch.column(0)), group, groups)
            if branches == [b""]:
                row, branch = np.arange(len(counts)), np.zeros(len(counts), np.int64)
            else:
                found = list(search(trie, counts))
                row, branch = (np.concatenate(x) for x in zip(*found))
            home = np.empty(len(counts), np.int64)
            begins = np.array([np.frombuffer(b.ljust(groups, b"\0"), np.uint8) for b in branches]).reshape(len(branches), groups)
            exact = np.ones(len(row), bool)
            for level in range(groups):
                deep = np.array([len(b) > level for b in branches])[branch]
                exact &= ~deep | (counts[row, level] == begins[branch, level])
            home[row[exact]] = branch[exact]
            later = branch >= home[row]
            row, branch, exact = row[later], branch[later], exact[later]
            for at in range(0, len(row), 1 << 16):
                part = slice(at, at + (1 << 16))
                taken = batch.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(branch[part]), pa.array(exact[part]), taken.column(0), taken.column(1)], ["branch", "own", "word", "n"])
    return run


def _search_branch(group: np.ndarray, groups: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column, n = table.column("word").combine_chunks(), table.column("n").to_numpy()
        found, total, best = near_in_branch(column, n, table.column("own").to_numpy(), group, groups)
        return pa.table({"word": column.take(pa.array(found)), "n_near": total, "best": column.take(pa.array(best)), "best_n": n[best]})
    return run


def near_words(vocabulary: DataFrame, groups: int = GROUPS, most: int = BRANCH_WORDS) -> DataFrame:
    """(word, n_near, best, best_n): words with near ones, their number and the most frequent of them."""
    group = letter_groups(vocabulary, groups)
    with_vectors = vocabulary.select("word", "n").mapInArrow(_with_vectors(group, groups), "word string, n long, vector binary")
    branches = _cut(with_vectors, groups, most)
    asked = vocabulary.select("word", "n").mapInArrow(_ask(branches, group, groups), "branch long, own boolean, word string, n long")
    dealt = asked.repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")), "branch")
    found = dealt.groupBy("branch").applyInArrow(_search_branch(group, groups), "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best")).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("first.best").alias("best"), (-F.col("first.order")).alias("best_n"))


def _roots(forms: DataFrame, scratch: str) -> DataFrame:
    """(word, root): forms followed to the last, twice as far in each round.

    Counts at least double from a word to its form, so a way has no circle and at most 63 steps.
    """
    spark = forms.sparkSession
    roots, round_ = forms.select("word", F.col("form").alias("root")), 0
    while True:
        path = f"{scratch}/roots-{round_}"
        roots.write.parquet(path)
        if round_:
            remove_path(spark, f"{scratch}/roots-{round_ - 1}")
        roots, round_ = spark.read.parquet(path), round_ + 1
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, groups: int = GROUPS, most: int = BRANCH_WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per word: n occurrences, n_near words one edit apart, its form and that one's form_n, and the root."""
    spark, scratch = docs.sparkSession, scratch_path(docs.sparkSession, "spelling")
    vocabulary(docs, id_col, text_col).write.parquet(f"{scratch}/words")
    known = spark.read.parquet(f"{scratch}/words")
    near = near_words(known, groups, most)
    fits = F.col("best_n") >= 2 * F.col("n")
    known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    ).write.parquet(f"{scratch}/forms")
    remove_path(spark, f"{scratch}/words")
    forms = spark.read.parquet(f"{scratch}/forms")
    roots = _roots(forms.where("form is not null"), scratch)
    return forms.join(roots, "word", "left").select(
        "word", F.coalesce("form", F.lit(None)).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
