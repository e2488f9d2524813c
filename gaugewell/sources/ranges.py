"""Records that line ends do not delimit, read by many tasks from one file.

A file is read in pieces between separators, by ranges, as any text. What a range means depends on what
stands before it: a line may begin inside quotes, a brace may stand inside a string or at any depth, and half of a
UTF-16 character may look like a line end. So each range is first passed over for every state in which it can begin, which
gives one row per range: the state it ends in for each of them. Those rows are composed along each file, which tells
the state in which every range begins, and a second pass cuts the records. A record that
goes on in the next range is returned in parts, one for each range, which are put together.

Both passes stream; a task holds one batch and the record that it is in.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugewell.session import ship

#: Encodings of two bytes a character, with their marks at the beginning of a file (fixed values).
WIDE = {"UTF-16LE": b"\xff\xfe", "UTF-16BE": b"\xfe\xff"}
_UTF8_MARK = b"\xef\xbb\xbf"
_PARTS = "file string, opener long, place long, whole boolean, first boolean, value binary"


def pieces(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, start, value): what stands between separators; ``start`` is that of the range it was read in."""
    text = spark.read.option("lineSep", separator).option("encoding", encoding).text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where another range begins."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        code = file.indices.to_numpy()
        cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield file.dictionary[int(code[low])].as_py(), int(start[low]), batch.slice(low, high - low)


def _summarize(new: Callable):
    """One row per range: file, start and what the scan says of it in the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scan = None, None
        for file, start, rows in _by_range(batches):
            if at != (file, start):
                if scan is not None:
                    yield _row(at, scan.summary())
                at, scan = (file, start), new()
            scan.feed(rows.column(2))
        if scan is not None:
            yield _row(at, scan.summary())

    def _row(at: tuple, summary: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], **{k: pa.array([v], pa.int64()) for k, v in summary.items()}})
    return run


def _cut(new: Callable, names: list[str]):
    """Records and parts of records, by a scan that starts in the state given with the range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scan = None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            opener, whole, first, value = columns
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(value), pa.string()), pa.array(opener, pa.int64()), pa.array([at[1]] * len(value), pa.int64()),
                 pa.array(whole, pa.bool_()), pa.array(first, pa.bool_()), pa.array(value, pa.binary())], [f.split()[0] for f in _PARTS.split(", ")])

        for file, start, rows in _by_range(batches):
            if at != (file, start):
                if scan is not None:
                    yield out(scan.end())
                state = {n: rows.column(rows.schema.get_field_index(n))[0].as_py() or 0 for n in names}
                at, scan = (file, start), new(start, state)
            yield out(scan.feed(rows.column(2)))
        if scan is not None:
            yield out(scan.end())
    return run


def _joined(parts: DataFrame, separator: bytes) -> DataFrame:
    """(file, first, value): the whole records, and those put together from their parts.

    The parts of a record lie in neighbouring ranges; a record is a row in any case.
    """
    whole = parts.where("whole").select("file", "first", "value")
    ordered = F.array_sort(F.collect_list(F.struct("place", "value")))
    texts = F.transform(ordered, lambda p: F.hex(p["value"]))
    value = F.unhex(F.array_join(texts, separator.hex().upper()))
    broken = parts.where(~F.col("whole")).groupBy("file", "opener").agg(F.max("first").alias("first"), value.alias("value"))
    return whole.union(broken.select("file", "first", "value"))


def _kept(states: DataFrame) -> DataFrame:
    """The states, found once: a few numbers for each range at most, and the driver lists the ranges to read them anyway."""
    return states.sparkSession.createDataFrame(states.toArrow())


def _before(*order: str) -> Window:
    return Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


# ------------------------------------------------------------------ delimited text


@dataclass(frozen=True)
class Quoting:
    """How fields are delimited and quoted, in text of one encoding."""

    separator: str = ","
    quote: str = '"'
    encoding: str = "UTF-8"

    @property
    def wide(self) -> bool:
        return self.encoding in WIDE

    def line_end(self) -> bytes:
        return "\n".encode(self.encoding if self.wide else "ascii")

    def quoted(self, line: bytes, inside: bool, goes_on: bool = False) -> bool:
        """Whether a line ends inside quotes; ``goes_on`` if it is the rest of a line that began elsewhere."""
        text = line.decode(self.encoding if self.wide else "latin-1", "replace")
        quote, opening, at = self.quote, self.separator + self.quote, 0
        if not inside and text.startswith(quote) and not goes_on:
            inside, at = True, 1
        while True:
            if not inside:
                found = text.find(opening, at)
                if found < 0:
                    return False
                inside, at = True, found + len(opening)
            found = text.find(quote, at)
            if found < 0:
                return True
            if text.startswith(quote, found + 1):
                at = found + 2
            else:
                inside, at = False, found + 1


class _Lines:
    """True lines of a range: with two bytes a character, a line end at an odd place is half of two characters.

    ``fragment`` is set while the line is the rest of one that began before the range.
    """

    def __init__(self, quoting: Quoting, odd: bool) -> None:
        self.end, self.wide = quoting.line_end(), quoting.wide
        self.fragment = odd
        self.held: list[bytes] = []
        self.odd = odd

    def feed(self, values: pa.Array) -> Iterator[tuple[bytes, bool]]:
        """(line, whether it goes on from before the range) of the lines that are complete."""
        if not self.wide:
            for line in values.to_pylist():
                yield line, False
            return
        for line in values.to_pylist():
            self.held.append(line)
            if len(line) % 2:
                self.odd = not self.odd
            if not self.odd:
                yield self.end.join(self.held), self.fragment
                self.held, self.fragment = [], False

    def rest(self) -> bytes | None:
        """What is left of a line that goes on behind the range."""
        return self.end.join(self.held) if self.held else None


class _QuoteSummary:
    """The quote states in which a range ends, and whether a record begins in it, for each state it can begin in."""

    def __init__(self, quoting: Quoting) -> None:
        self.quoting = quoting
        self.lines = {odd: _Lines(quoting, bool(odd)) for odd in ((0, 1) if quoting.wide else (0,))}
        self.state = {(odd, inside): inside for odd in (0, 1) for inside in (0, 1)}
        self.begins = dict.fromkeys(self.state, 0)
        self.odd = 0

    def feed(self, values: pa.Array) -> None:
        if self.quoting.wide:
            self.odd ^= int(np.sum(pc.binary_length(values).to_numpy() & 1) & 1)
            for odd, lines in self.lines.items():
                for line, goes_on in lines.feed(values):
                    self._line(odd, line, goes_on)
            return
        # lines without a quote change nothing; a record begins on a line that is not inside quotes
        found = np.flatnonzero(pc.find_substring(values, self.quoting.quote).to_numpy() >= 0)
        at = 0
        for row in [*found.tolist(), len(values)]:
            for inside in (0, 1):
                if row > at and not self.state[0, inside]:
                    self.begins[0, inside] = 1
            if row < len(values):
                self._line(0, values[row].as_py(), False)
            at = row + 1

    def _line(self, odd: int, line: bytes, goes_on: bool) -> None:
        body = line[1:] if goes_on else line
        # what begins inside quotes and what does not mostly end alike
        ends = {inside: int(self.quoting.quoted(body, bool(inside), goes_on)) for inside in {self.state[odd, 0], self.state[odd, 1]}}
        for inside in (0, 1):
            if not goes_on and not self.state[odd, inside]:
                self.begins[odd, inside] = 1
            self.state[odd, inside] = ends[self.state[odd, inside]]

    def summary(self) -> dict[str, int]:
        for odd, lines in self.lines.items():
            rest = lines.rest()
            if rest is not None:
                self._line(odd, rest, lines.fragment)
        return {"odd": self.odd, **{f"to_{o}{i}": v for (o, i), v in self.state.items()}, **{f"begins_{o}{i}": v for (o, i), v in self.begins.items()}}


class _QuoteCut:
    """Records of a range whose first state is known."""

    def __init__(self, quoting: Quoting, start: int, state: dict[str, int]) -> None:
        self.quoting, self.start = quoting, start
        self.lines = _Lines(quoting, bool(state["odd"]))
        self.inside, self.opener = bool(state["inside"]), state["opener"]
        self.head = self.inside or bool(state["odd"])  # the record began before the range
        self.held: list[bytes] = []
        self.seen = start > 0  # the first record of a file is its header

    def feed(self, values: pa.Array) -> list[tuple]:
        found: list[tuple] = []
        lines = self.lines.feed(values)
        plain = None if self.quoting.wide else (pc.find_substring(values, self.quoting.quote).to_numpy() < 0).tolist()
        for row, (line, goes_on) in enumerate(lines):
            if plain is None or not plain[row]:
                self.inside = self.quoting.quoted(line[1:] if goes_on else line, self.inside, goes_on)
            self.held.append(line)
            if not self.inside:
                self._close(found)
        return found

    def _close(self, found: list[tuple]) -> None:
        value = self.quoting.line_end().join(self.held)
        if self.head:
            found.append((self.opener, False, False, value))
        elif not self.seen or value.strip(b"\x00 \t\r\n"):
            found.append((self.start, True, not self.seen, value))
            self.seen = True
        self.held, self.head = [], False

    def end(self) -> list[tuple]:
        """The part of a record that goes on behind the range, or ends with the file."""
        rest = self.lines.rest()
        if rest is not None:
            self.held.append(rest)
        if not self.held:
            return []
        value = self.quoting.line_end().join(self.held)
        return [(self.opener if self.head else self.start, False, not self.seen and not self.head, value)]


def _chosen(prefix: str, *states: Column) -> Column:
    """The column of a summary that belongs to the given states."""
    odd, inside = states
    pick = lambda o: F.when(inside == 1, F.col(f"{prefix}_{o}1")).otherwise(F.col(f"{prefix}_{o}0"))
    return F.when(odd == 1, pick(1)).otherwise(pick(0))


def quote_states(ranges: DataFrame) -> DataFrame:
    """(file, start, odd, inside, opener) of the ranges that begin inside a record, from the summaries of all.

    A range either ends in one state however it begins, or keeps the quote state, or turns it. So the state
    before a range is that of the last range of the first kind, turned as often as ranges since then turn it.
    """
    odd = F.pmod(F.coalesce(F.sum("odd").over(_before("start")), F.lit(0)), F.lit(2)).alias("odd_before")
    maps = ranges.select("*", odd)
    zero, one = (F.when(F.col("odd_before") == 1, F.col(f"to_1{i}")).otherwise(F.col(f"to_0{i}")) for i in (0, 1))
    maps = maps.withColumn("from_0", zero).withColumn("from_1", one)
    turns = (F.col("from_0") == 1) & (F.col("from_1") == 0)
    maps = maps.withColumn("turned", F.sum(turns.cast("int")).over(_before("start").rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("from_0") == F.col("from_1"), F.struct(F.col("from_0").alias("state"), F.col("turned").alias("turned")))
    last = F.last(fixed, ignorenulls=True).over(_before("start"))
    turned = F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    maps = maps.withColumn("last", last).withColumn("turned_before", turned)
    inside = F.pmod(F.coalesce(F.col("last.state") - F.col("last.turned"), F.lit(0)) + F.col("turned_before"), F.lit(2))
    maps = maps.withColumn("inside", inside)
    begins = _chosen("begins", F.col("odd_before"), F.col("inside")) == 1
    opener = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(_before("start"))
    return maps.withColumn("opener", opener).where("inside = 1 or odd_before = 1").select(
        "file", "start", F.col("odd_before").alias("odd"), "inside", "opener")


def quoted_records(spark: SparkSession, path: str, quoting: Quoting) -> DataFrame:
    """(file, first, value): the records of delimited text, with line ends inside quotes; ``first`` marks a file's header."""
    ship(spark)
    found = pieces(spark, path, "\n", quoting.encoding if quoting.wide else "UTF-8")
    numbers = [f"{n}_{o}{i}" for n in ("to", "begins") for o in (0, 1) for i in (0, 1)]
    schema = "file string, start long, odd long, " + ", ".join(f"{n} long" for n in numbers)
    states = _kept(quote_states(found.mapInArrow(_summarize(lambda: _QuoteSummary(quoting)), schema)))
    # a row for each range that begins inside a record
    begun = found.join(F.broadcast(states), ["file", "start"], "left").select("file", "start", "value", "odd", "inside", "opener")
    parts = begun.mapInArrow(_cut(lambda start, state: _QuoteCut(quoting, start, state), ["odd", "inside", "opener"]), _PARTS)
    records = _joined(parts, quoting.line_end())
    mark = WIDE.get(quoting.encoding, _UTF8_MARK)
    marked = F.col("first") & (F.hex(F.substring("value", 1, len(mark))) == mark.hex().upper())
    value = F.when(marked, F.expr(f"substring(value, {len(mark) + 1})")).otherwise(F.col("value"))
    text = value.cast("string") if quoting.encoding == "UTF-8" else F.decode(value, quoting.encoding)
    return records.select("file", "first", F.rtrim(text, F.lit("\r")).alias("value")).where("first or trim(value) <> ''")


def header_names(header: str, quoting: Quoting) -> list[str]:
    """Column names of a header record; empty ones are numbered, and so are those that repeat."""
    names = next(csv.reader([header], delimiter=quoting.separator, quotechar=quoting.quote), [])
    names = [n or f"_c{i}" for i, n in enumerate(names)]
    lower = [n.lower() for n in names]
    return [f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


# ------------------------------------------------------------------ JSON arrays

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[0x5B, 0x7B]] = _CLOSE[[0x5D, 0x7D]] = True
_NOTHING = 1 << 40


def _structure(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text of pieces, each with the brace behind it, and at each byte whether it is a quote that opens or closes a string."""
    data = np.frombuffer(b"}".join([*values.to_pylist(), b""]), np.uint8)
    quotes = data == 0x22
    slashes = data == 0x5C
    if slashes.any():
        # the byte behind an odd run of backslashes is escaped; a run ends before the brace of its piece
        first = np.flatnonzero(slashes & ~np.concatenate([[False], slashes[:-1]]))
        last = np.flatnonzero(slashes & ~np.concatenate([slashes[1:], [False]]))
        quotes[(last + 1)[(last - first) % 2 == 0]] = False
    return data, quotes


class _JsonSummary:
    """For a range that begins outside a string and for one that begins inside: what it adds to the depth, and the least
    depth, against that at its beginning, at which a comma stands."""

    def __init__(self) -> None:
        self.quotes, self.depth, self.comma = 0, [0, 0], [_NOTHING, _NOTHING]

    def feed(self, values: pa.Array) -> None:
        data, quotes = _structure(values)
        outside = (np.cumsum(quotes) + self.quotes) & 1
        step = _OPEN[data].astype(np.int64) - _CLOSE[data]
        for begins in (0, 1):
            free = outside == begins
            depth = np.cumsum(np.where(free, step, 0)) + self.depth[begins]
            commas = depth[free & (data == 0x2C)]
            if len(commas):
                self.comma[begins] = min(self.comma[begins], int(commas.min()))
            self.depth[begins] = int(depth[-1])
        self.quotes += int(quotes.sum())

    def summary(self) -> dict[str, int]:
        return {"quotes": self.quotes & 1, "depth_0": self.depth[0], "depth_1": self.depth[1], "comma_0": self.comma[0], "comma_1": self.comma[1]}


class _JsonCut:
    """Elements of the outermost array in a range whose first state is known."""

    def __init__(self, start: int, state: dict[str, int]) -> None:
        self.start, self.opener = start, state["opener"]
        self.string, self.depth = state["inside"], state["depth"]
        self.head = self.depth > 0
        self.held: list[bytes] = []

    def feed(self, values: pa.Array) -> list[tuple]:
        data, quotes = _structure(values)
        free = ((np.cumsum(quotes) + self.string) & 1) == 0
        step = np.where(free, _OPEN[data].astype(np.int64) - _CLOSE[data], 0)
        depth = np.cumsum(step) + self.depth
        # an element ends at a comma in the outermost array and at its end, and begins behind its opening bracket or a comma
        begins = (step == 1) & (depth == 1)
        ends = ((data == 0x2C) & free & (depth == 1)) | ((step == -1) & (depth == 0))
        text, found, at = data.tobytes(), [], 0
        for place in np.flatnonzero(begins | ends).tolist():
            if begins[place]:
                self.held = []
            else:
                self.held.append(text[at:place])
                value = b"".join(self.held)
                if self.head:
                    found.append((self.opener, False, False, value))
                elif value.strip():
                    found.append((self.start, True, False, value))
                self.held, self.head = [], False
            at = place + 1
        self.depth, self.string = int(depth[-1]), int((quotes.sum() + self.string) & 1)
        if self.depth > 0:
            self.held.append(text[at:])
        return found

    def end(self) -> list[tuple]:
        value = b"".join(self.held)
        return [(self.opener if self.head else self.start, False, False, value)] if self.depth > 0 and value else []


def json_states(ranges: DataFrame) -> DataFrame:
    """(file, start, inside, depth, opener, depth_behind, inside_behind) of each range, from the summaries of all."""
    inside = F.pmod(F.coalesce(F.sum("quotes").over(_before("start")), F.lit(0)), F.lit(2))
    known = ranges.withColumn("inside", inside)
    adds, comma = (F.when(F.col("inside") == 1, F.col(f"{n}_1")).otherwise(F.col(f"{n}_0")) for n in ("depth", "comma"))
    known = known.withColumn("adds", adds).withColumn("depth", F.coalesce(F.sum("adds").over(_before("start")), F.lit(0)))
    begins = (F.col("start") == 0) | (comma + F.col("depth") == 1)
    opener = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(_before("start"))
    return known.select(
        "file", "start", "inside", "depth", opener.alias("opener"), (F.col("depth") + F.col("adds")).alias("depth_behind"),
        F.pmod(F.col("inside") + F.col("quotes"), F.lit(2)).alias("inside_behind"))


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """(value): the elements of JSON documents that are arrays, whatever lines they are on.

    A document that does not end as it began is an error.
    """
    ship(spark)
    found = pieces(spark, path, "}")
    schema = "file string, start long, quotes long, depth_0 long, depth_1 long, comma_0 long, comma_1 long"
    states = _kept(json_states(found.mapInArrow(_summarize(_JsonSummary), schema)))
    last = states.groupBy("file").agg(F.max_by(F.struct("depth_behind", "inside_behind"), "start").alias("end"))
    # the last piece of a file counts as if a brace stood behind it
    broken = last.where("end.depth_behind <> -1 or end.inside_behind <> 0").select("file").limit(1).collect()
    if broken:
        raise ValueError(f"Unable to parse JSON file {broken[0]['file']}: the outermost array does not end")
    begun = found.join(F.broadcast(states.select("file", "start", "inside", "depth", "opener")), ["file", "start"], "left")
    parts = begun.select("file", "start", "value", "inside", "depth", "opener").mapInArrow(_cut(_JsonCut, ["inside", "depth", "opener"]), _PARTS)
    # parts of an element follow each other without anything between them
    return _joined(parts, b"").select(F.col("value").cast("string").alias("value"))
