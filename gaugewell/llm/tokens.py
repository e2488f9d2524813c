"""Token counts that follow edits: only what an edit touches is encoded again.

A text is cut into leaves of some hundred characters at places where every split into pre-tokens has a
border, in any script: before white space that follows something else, and between a letter, a digit and a mark, but not
behind an apostrophe. The leaves' counts and lengths are summed up in a tree. An edit takes the leaves it
touches and one on each side, whose outer borders it cannot reach; their text is edited, cut and encoded
and put in their place, and the sums above are renewed. Where an edit needs more leaves than it
took, the tree is built anew from the sums of all leaves, without encoding the others. Only a
run of letters, digits or marks without any border, which is one pre-token, makes a longer leaf.

The vocabulary is a rank file given by its path; the driver reads it and tasks get its bytes.

Cases: null and empty texts have no tokens; edits are in positions of the original text, are
clipped to it and, where they overlap, the later one wins; null edits are none; a null
replacement deletes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from unicodedata import category

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.texts import pieces, text_or_empty
from gaugewell.session import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split into pre-tokens that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARACTERS = 256

# White space of Unicode (fixed values).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _UNKNOWN = range(6)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point; what Unicode has not assigned may be anything."""
    kind = {"L": _LETTER, "N": _DIGIT}
    found = np.array([_UNKNOWN if (c := category(chr(i))) == "Cn" else kind.get(c[0], _MARK) for i in range(0x110000)], np.uint8)
    found[_WHITE], found[0x27] = _SPACE, _APOSTROPHE
    return found


@cache
def _borders() -> np.ndarray:
    """Whether there is a border between a character of one kind and one of another, whatever stands around them."""
    found = np.zeros((6, 6), bool)
    words = [_LETTER, _DIGIT, _MARK, _APOSTROPHE]
    for left in words:
        found[left, _SPACE] = True
        for right in words:
            found[left, right] = left != right
    found[_MARK, _APOSTROPHE] = found[_APOSTROPHE, _MARK] = False  # marks of one run
    found[_APOSTROPHE, _LETTER] = False  # what follows may be a contraction
    return found


@cache
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    lines = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def cut(text: str) -> list[str]:
    """The text in leaves that begin where a pre-token begins in any case."""
    if len(text) <= LEAF_CHARACTERS:
        return [text]
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    safe = np.flatnonzero(_borders()[kind[:-1], kind[1:]]) + 1
    chosen = np.searchsorted(safe, np.arange(LEAF_CHARACTERS, len(text), LEAF_CHARACTERS))
    at = [0, *np.unique(safe[chosen[chosen < len(safe)]]).tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


class TokenTree:
    """Leaves of a text with sums of their characters and tokens above them."""

    def __init__(self, text: str, encode) -> None:
        self.encode, self.encoded = encode, 0
        leaves = cut(text)
        self._build(leaves, [len(leaf) for leaf in leaves], [self._measure(leaf) for leaf in leaves])

    def _measure(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encode(text)) if text else 0

    def _build(self, leaves: list[str], characters: list[int], tokens: list[int]) -> None:
        """The tree over leaves of known sums, with half as much room again."""
        count = len(leaves)
        self.size = 1 << max(0, (count + count // 2 - 1).bit_length())
        empty = [0] * (self.size - count)
        self.leaves = leaves + [""] * len(empty)
        self.characters, self.tokens = [0] * self.size + characters + empty, [0] * self.size + tokens + empty
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _fill(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        self.characters[self.size + leaf], self.tokens[self.size + leaf] = len(text), tokens

    def _sum(self, node: int) -> None:
        self.characters[node] = self.characters[2 * node] + self.characters[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def count(self) -> int:
        return self.tokens[1]

    def length(self) -> int:
        return self.characters[1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where it begins."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position - start >= self.characters[node] and self.characters[node + 1]:
                start += self.characters[node]
                node += 1
        return node - self.size, start

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in the place of the characters ``start`` to ``end``."""
        low, begin = self.find(start)
        high, _ = self.find(max(start, end - 1))
        low = self._beside(low, -1)
        begin -= sum(len(self.leaves[i]) for i in range(low, self.find(start)[0]))
        high = self._beside(high, 1)
        whole = "".join(self.leaves[low:high + 1])
        parts = cut(whole[:start - begin] + text + whole[end - begin:])
        tokens = [self._measure(part) for part in parts]
        room = high + 1 - low
        if len(parts) > room:
            known = list(zip(self.leaves, self.characters[self.size:], self.tokens[self.size:]))
            rows = [*known[:low], *zip(parts, map(len, parts), tokens), *known[high + 1:]]
            self._build(*map(list, zip(*(r for r in rows if r[0]))))
            return
        for i in range(room):
            self._fill(low + i, parts[i] if i < len(parts) else "", tokens[i] if i < len(parts) else 0)
        touched = {(self.size + i) // 2 for i in range(low, high + 1)}
        while touched and max(touched) >= 1:
            for node in touched:
                self._sum(node)
            touched = {node // 2 for node in touched if node > 1}

    def _beside(self, leaf: int, step: int) -> int:
        """The next leaf on that side that is not empty, or the outermost."""
        other = leaf + step
        while 0 <= other < self.size and not self.leaves[other]:
            other += step
        return min(max(other, 0), self.size - 1)


def _count(ranks: bytes, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            for piece in pieces(batch):
                rows = []
                for text, edits in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    tree = TokenTree(text, encode)
                    size, before, tree.encoded, limit = len(text), tree.count(), 0, len(text)
                    edits = [e for e in edits or () if e and e["start"] is not None and e["end"] is not None]
                    for edit in sorted(edits, key=lambda e: (e["start"], e["end"]), reverse=True):
                        start = min(max(edit["start"], 0), limit)
                        tree.replace(start, min(max(edit["end"], start), limit), edit["text"] or "")
                        limit = start
                    rows.append((size, before, tree.length(), tree.count(), tree.encoded))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))],
                    ["id", "n_chars", "n_tokens", "n_edited_chars", "n_edited_tokens", "n_encoded_again"])
    return run


def token_counts(
    docs: DataFrame, edits: Column | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: id, n_chars, n_tokens, and the same after its edits with the characters encoded again.

    ``edits`` is an array<struct<start, end, text>> over the columns of ``docs``, in code points.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    edit = "array<struct<start: long, end: long, text: string>>"
    edits = (F.array() if edits is None else edits).cast(edit)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"), edits.alias("edits"))
    counted = rows.mapInArrow(
        _count(Path(vocabulary).read_bytes(), pattern),
        f"id {kind}, n_chars long, n_tokens long, n_edited_chars long, n_edited_tokens long, n_encoded_again long")
    return counted.withColumnRenamed("id", id_col)
