"""Secrets in whole texts, found by one automaton for all rules in one pass over the bytes.

Texts are cut behind bytes after which no rule can be under way, so the pieces are
independent and run through the transition table side by side. Pieces in which a rule ends
are resolved by automata of that rule alone: forward to the first end, backward to the
leftmost start, forward to the longest end, and on from there. A rule may ask for a length;
shorter findings are dropped after they have taken their place.

Cases: null and empty texts have no findings; repeated rows each keep their own; positions are
code points, the end is exclusive; only ASCII letters fold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.automaton import Automaton
from gaugewell.llm.texts import annotate, pieces, text_or_empty, utf8
from gaugewell.session import ship


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool  # letters in either case
    least: int  # characters of the measured group
    group: int
    #: What the shared pass looks for, if not the pattern; it occurs in every finding. Counting
    #: fewer characters there keeps the automaton small, and resolving is exact in any case.
    seen: str = ""


# The base kinds and their patterns are fixed values.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 16, 0),
    Rule("hex", r"[0-9a-f]+", False, 32, 0, r"[0-9a-f]{14}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", False, 40, 0),
    Rule("google", r"AIza[A-Za-z0-9_-]+", False, 39, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 20, 0),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", False, 24, 0),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 40, 0),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 0),
)

#: With fewer pieces under way than this, they are finished one by one.
_TOGETHER = 128


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = Automaton([(r.seen or r.pattern, r.fold) for r in rules], search=True)
        own = [[(r.pattern, r.fold)] for r in rules]
        self.search = [Automaton(o, search=True) for o in own]
        self.backward = [Automaton(o, search=False, backward=True) for o in own]
        self.anchored = [Automaton(o, search=False) for o in own]
        self.exact = [re.compile(r.pattern.encode(), re.IGNORECASE if r.fold else 0) for r in rules]

    def seen(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the independent pieces, and the rules that end in each as bits."""
        auto = self.all
        cut = auto.resets[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = ~cut
        begins[1:] &= cut[:-1] | edge[1:-1]
        starts = np.flatnonzero(begins)
        last = ~cut
        last[:-1] &= cut[1:] | edge[1:-1]
        ends = np.flatnonzero(last) + 1
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        starts, ends = starts[order], ends[order]
        lengths = ends - starts
        state = np.zeros(len(starts), np.int32)
        found = np.zeros(len(starts), np.int64)
        letters = auto.classes[data]
        step, active = 0, len(starts)
        while active:
            active = int(np.searchsorted(-lengths[:active], -step, "left"))
            if active < _TOGETHER:
                break
            state[:active] = auto.table[state[:active] + letters[starts[:active] + step]]
            found[:active] |= auto.accepts[state[:active]]
            step += 1
        table, accepts = auto.table, auto.accepts
        for lane in range(active):
            at, bits = state[lane], 0
            for letter in letters[starts[lane] + step:ends[lane]].tolist():
                at = table[at + letter]
                bits |= accepts[at]
            found[lane] |= bits
        hit = np.flatnonzero(found)
        hit = hit[np.argsort(starts[hit])]
        return starts[hit], ends[hit], found[hit]

    def resolve(self, rule: int, text: bytes) -> Iterator[tuple[int, int]]:
        """Leftmost longest findings of one rule that do not overlap, in one piece."""
        search, backward, anchored = self.search[rule], self.backward[rule], self.anchored[rule]
        least, group, taken, size = self.rules[rule].least, self.rules[rule].group, 0, len(text)
        while True:
            state, at = 0, taken
            while at < size:
                state = search.table[state + search.classes[text[at]]]
                at += 1
                if search.accepts[state]:
                    break
            else:
                return
            state, start = 0, at
            for i in range(at - 1, taken - 1, -1):
                state = backward.table[state + backward.classes[text[i]]]
                if backward.accepts[state]:
                    start = i
            state, end = 0, at
            for i in range(start, size):
                state = anchored.table[state + anchored.classes[text[i]]]
                if anchored.accepts[state]:
                    end = i + 1
                elif i >= at:
                    # behind the first end, a finding goes on without a gap in every rule here
                    break
            if end - start >= least:
                exact = self.exact[rule].fullmatch(text, start, end)
                if exact and len(exact[group]) >= least:
                    yield start, end
            taken = end

    def findings(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each document its findings as (byte start, rule, byte end), sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in offsets[1:]]
        starts, ends, rules = self.seen(data, offsets)
        owners = np.searchsorted(offsets, starts, "right") - 1
        for start, end, bits, owner in zip(starts.tolist(), ends.tolist(), rules.tolist(), owners.tolist()):
            text, base = data[start:end].tobytes(), start - int(offsets[owner])
            for rule in range(len(self.rules)):
                if bits >> rule & 1:
                    found[owner].extend((base + s, rule, base + e) for s, e in self.resolve(rule, text))
        for rows in found:
            rows.sort()
        return found


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once, on the driver; tasks get the finished tables."""
    return Scanner(rules)


def _characters(text: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    return np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _find(scan: Scanner):
    rules = scan.rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = utf8(piece.column(1))
                rows = []
                for i, found in enumerate(scan.findings(data, offsets)):
                    if found:
                        at = _characters(data[offsets[i]:offsets[i + 1]])
                        found = [{"kind": rules[r].kind, "start": int(at[s]), "end": int(at[e])} for s, r, e in found]
                    rows.append(found)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.list_(_FINDING))], ["id", "findings"])
    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, findings array<struct<kind, start, end>> by start, then kind as listed."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
        .mapInArrow(_find(scanner(rules)), f"id {kind}, findings array<struct<kind: string, start: long, end: long>>")
        .withColumnRenamed("id", id_col)
    )


def joined(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their findings, and all findings as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"].isin([r.kind for r in BASE]))
    return found.select(id_col, *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("findings")).alias("spans"))


def redact_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", text_col: str = "text", size_col: str = "n_chars",
) -> DataFrame:
    """The same rows and columns with each finding replaced; overlapping findings get one mark.

    A null text stays null; the number of characters is renewed where a text has changed.
    """
    scan, stamp = scanner(rules), mark.encode()

    def compute(data: np.ndarray, offsets: np.ndarray) -> dict[str, list]:
        texts: list[str | None] = []
        for i, found in enumerate(scan.findings(data, offsets)):
            text, at, parts = data[offsets[i]:offsets[i + 1]].tobytes() if found else b"", 0, []
            for start, _, end in found:
                if start >= at:
                    parts += [text[at:start], stamp]
                at = max(at, end)
            texts.append(b"".join([*parts, text[at:]]).decode() if found else None)
        return {"__redacted": pa.array(texts, pa.string())}

    rows, given = annotate(docs, compute, "__redacted string", text_col)
    columns = []
    for name, column in zip(docs.columns, given):
        if name == text_col:
            column = F.coalesce("__redacted", column).alias(name)
        elif name == size_col:
            size = F.length("__redacted").cast(docs.schema[name].dataType)
            column = F.when(F.col("__redacted").isNotNull(), size).otherwise(column).alias(name)
        columns.append(column)
    return rows.select(*columns)
