"""Records that line breaks or commas inside values do not end, read by many tasks from one file.

A text scan gives pieces of a file (lines, or what stands between commas) in the tasks of its splits. Whether a piece begins
a record depends on all text before it, but only through a small state: whether a quoted value is open, and how deep
brackets are nested. One pass computes, for each split, how it changes the state from either start; windows over the
splits of a file turn that into the state each split starts in; a second pass cuts records. Records that cross a
border of splits are put together from the few fragments at the borders. No task reads a whole file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import ROW_ID, SOURCE_FILE
from ..session import durable

#: Start states of up to so many splits are broadcast; beyond, pieces and states meet in a shuffle.
BROADCAST_SPLITS = 1_000_000
_BORDER_STATES = f"{SOURCE_FILE} string, split long, place int, end0 boolean, end1 boolean, deeper0 long, deeper1 long"
_CUT = f"record string, {SOURCE_FILE} string, {ROW_ID} long, began boolean"
_SPLIT_BITS = 33


def _steps(scanner, open_: bool, pieces: list[str]) -> tuple[bool, int]:
    """The state behind many pieces, one after the other, and how much deeper brackets are."""
    deeper = 0
    for piece in pieces:
        open_, more = scanner.step(open_, piece)
        deeper += more
    return open_, deeper


class QuotedLines:
    """Lines of delimited text: a record starts where no quoted value is open. A quote opens a value only where a field
    starts, ``""`` inside one is a quote, and what follows a closing quote belongs to the field."""

    joiner, quote = "\n", '"'

    def __init__(self, separator: str) -> None:
        s = re.escape(separator)
        self.separator = separator
        self.closing = re.compile(r'(?:[^"]|"")*+"')
        self.fields = re.compile(rf'(?:(?:"(?:[^"]|"")*+"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+')

    def step(self, open_: bool, line: str) -> tuple[bool, int]:
        """Whether a value is open behind the line, and how much deeper brackets are (here never)."""
        if '"' not in line:
            return open_, 0
        at = 0
        if open_:
            closed = self.closing.match(line)
            if closed is None:
                return True, 0
            at = line.find(self.separator, closed.end()) + 1
            if at == 0:
                return False, 0
        at = self.fields.match(line, at).end()
        return line.startswith('"', at) and self.closing.match(line, at + 1) is None, 0

    def steps(self, open_: bool, lines: list[str]) -> tuple[bool, int]:
        return _steps(self, open_, lines)

    def starts(self, open_: bool, depth: int) -> bool:
        return not open_

    def whole(self, open_: bool, depth: int) -> bool:
        return not open_

    def clean(self, line: str, first: bool, open_: bool, depth: int) -> str:
        return line


class ArrayElements:
    """What stands between the commas of a JSON document whose root is an array: an element starts at depth 1, outside
    strings. No escape crosses a comma, so a string is open or not by the quotes that no backslash precedes."""

    joiner, quote = ",", '"'

    def __init__(self) -> None:
        self.escape, self.strings = re.compile(r"\\."), re.compile(r'"[^"]*+(?:"|$)')

    def step(self, open_: bool, piece: str) -> tuple[bool, int]:
        if "\\" in piece:
            piece = self.escape.sub("", piece)
        if '"' in piece or open_:
            after = open_ ^ piece.count('"') % 2 == 1
            piece = self.strings.sub("", '"' + piece if open_ else piece)
        else:
            after = False
        return after, piece.count("[") + piece.count("{") - piece.count("]") - piece.count("}")

    def steps(self, open_: bool, pieces: list[str]) -> tuple[bool, int]:
        """All pieces at once: what crosses a comma is only an open string, which the text as a whole shows as well."""
        return self.step(open_, ",".join(pieces))

    def starts(self, open_: bool, depth: int) -> bool:
        return not open_ and depth == 1

    def whole(self, open_: bool, depth: int) -> bool:
        return not open_ and depth <= 1

    def clean(self, piece: str, first: bool, open_: bool, depth: int) -> str:
        if first:
            piece = piece.removeprefix("﻿").lstrip()[1:]
        return piece[:piece.rindex("]")] if depth <= 0 and not open_ and "]" in piece else piece


class XmlTags:
    """What stands between the ``>`` of an XML text: a piece ends with at most one tag, which may go a level down or up.
    Comments and CDATA sections may hold any ``>``; a ``>`` inside an attribute's value is not provided for."""

    def step(self, open_: bool, piece: str) -> tuple[bool, int]:
        if open_:
            return not piece.endswith(("--", "]]")), 0
        tag = self.tag(piece)
        if tag.startswith("!--"):
            return not (tag.endswith("--") and len(tag) > 4), 0
        if tag.startswith("![CDATA["):
            return not tag.endswith("]]"), 0
        if tag[:1] in ("", "!", "?"):
            return False, 0
        return False, -1 if tag.startswith("/") else 0 if tag.endswith("/") else 1

    def steps(self, open_: bool, pieces: list[str]) -> tuple[bool, int]:
        return _steps(self, open_, pieces)

    @staticmethod
    def tag(piece: str) -> str:
        """What the piece has behind its ``<``: of a piece that ends a text with ``<`` signs in a comment, the first."""
        return piece[piece.find("<") + 1:] if "<" in piece else ""


_NAME = re.compile(r"[^\s/]+")
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"[^"]*"|'[^']*')""")


def _tag_outline(scanner: XmlTags, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, column, n, place) of each split: how often tags stand below the root (column NULL), and where the columns of
    their records are first named: attributes, children's attributes as ``child.attribute``, children."""
    split_of, record = None, None
    found: dict[tuple, list] = {}

    def note(tag, column, place, n=0):
        entry = found.setdefault((tag, column), [0, place])
        entry[0] += n

    for batch in batches:
        pieces, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for file, split, low, high in _runs(batch):
            if split_of != (file, split):
                split_of, record = (file, split), None
                open_, depth = batch.column(3)[low].as_py(), batch.column(4)[low].as_py()
            for at in range(low, high):
                before, was_open = depth, open_
                open_, more = scanner.step(open_, pieces[at])
                depth += more
                tag = "" if was_open else scanner.tag(pieces[at])
                if before not in (1, 2) or tag[:1] in ("", "!", "?", "/"):
                    continue
                name = _NAME.match(tag).group().rsplit(":", 1)[-1]
                attributes = [a.rsplit(":", 1)[-1] for a in _ATTRIBUTE.findall(tag)]
                if before == 1:
                    record = name
                    note(record, None, (file, ids[at], 0), 1)
                    for k, a in enumerate(attributes):
                        note(record, a, (file, ids[at], k))
                elif record is not None:
                    for k, a in enumerate(attributes):
                        note(record, f"{name}.{a}", (file, ids[at], k))
                    note(record, name, (file, ids[at], len(attributes)))
    rows = [(tag, column, n, *place) for (tag, column), (n, place) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else [[]] * 6, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
        ["tag", "column", "n", "file", "row", "k"])


def tag_outline(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((tag, column, n, place), (_source_file, depth)): the tags below the roots with the columns their records name, in
    which NULL stands for the tag itself, and how deep the text is nested at the end of each file: 0 if it is well-formed."""
    scanner = XmlTags()
    states, with_states = _placed(pieces.select("value", SOURCE_FILE, ROW_ID), scanner)
    rows = with_states(states).mapInArrow(lambda b: _tag_outline(scanner, b),
                                          "tag string, column string, n long, file string, row long, k long")
    outline = rows.groupBy("tag", "column").agg(F.sum("n").alias("n"), F.min(F.struct("file", "row", "k")).alias("place"))
    ends = states.groupBy(SOURCE_FILE).agg(F.max_by("depth_after", "split").alias("depth"), F.max("depth_after").alias("deepest"),
                                           F.min("depth_after").alias("least"))
    return outline, ends


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, split, first row, row behind the last) of the runs of rows of one split."""
    files, ids = batch.column(1), batch.column(2).to_numpy()
    splits = ids >> _SPLIT_BITS
    start = 0
    names = files.to_pylist()
    for at in range(1, batch.num_rows + 1):
        if at == batch.num_rows or splits[at] != splits[start] or names[at] != names[start]:
            yield names[start], int(splits[start]), start, at
            start = at


def _border_states(scanner, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split's pieces change the state, from either start. A split may come in several batches: in parts."""
    place = 0
    for batch in batches:
        rows = []
        for file, split, low, high in _runs(batch):
            pieces = batch.column(0).slice(low, high - low).to_pylist()
            ends, deeper = zip(*[scanner.steps(start, pieces) for start in (False, True)])
            rows.append((file, split, place, *ends, *deeper))
            place += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()))],
            [SOURCE_FILE, "split", "place", "end0", "end1", "deeper0", "deeper1"])


def _start_states(parts: DataFrame) -> DataFrame:
    """(file, split, open, depth, open_after, depth_after): the state each split starts and ends in.

    From either start a part of a split leaves the state as it is, turns it around, or sets it. So a state is the last one
    set before, turned around as often as parts since then do it; depths add up.
    """
    order = Window.partitionBy(SOURCE_FILE).orderBy("split", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = parts.withColumn("turn", (F.col("end0") & ~F.col("end1")).cast("long")).withColumn(
        "turned", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sets = F.when(F.col("end0") == F.col("end1"), F.struct(F.col("end0").alias("to"), "turned"))
    seen = turns.withColumn("turned_before", F.col("turned") - F.col("turn")).withColumn("set", F.last(sets, ignorenulls=True).over(before))
    parity = (F.col("turned_before") - F.coalesce("set.turned", F.lit(0))) % 2 == 1
    states = seen.withColumn("open", F.coalesce("set.to", F.lit(False)) != parity)
    states = states.withColumn("deeper", F.when(F.col("open"), F.col("deeper1")).otherwise(F.col("deeper0")))
    states = states.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    after = F.when(F.col("open"), F.col("end1")).otherwise(F.col("end0"))
    return states.groupBy(SOURCE_FILE, "split").agg(
        F.min_by("open", "place").alias("open"), F.min_by("depth", "place").alias("depth"),
        F.max_by(after, "place").alias("open_after"), F.max_by(F.col("depth") + F.col("deeper"), "place").alias("depth_after"))


def _cut(scanner, fragments: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records that lie in one split whole, or the fragments of those that do not. Rows: piece, file, row id, and the
    state the split starts in."""
    split_of = held = None
    open_, depth, first = False, 0, False

    def closed(finished: bool):
        """The record at hand as an output row, or None if the other kind is wanted."""
        texts, row, began = held
        return (scanner.joiner.join(texts), split_of[0], row, began) if (began and finished) != fragments else None

    for batch in batches:
        out = []
        pieces, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for file, split, low, high in _runs(batch):
            if split_of != (file, split):
                if held:
                    out.append(closed(scanner.whole(open_, depth)))
                split_of, held = (file, split), None
                open_, depth = batch.column(3)[low].as_py(), batch.column(4)[low].as_py()
                first = split == 0
            for at in range(low, high):
                piece = pieces[at]
                if first or scanner.starts(open_, depth):
                    if held:
                        out.append(closed(True))
                    held = ([], ids[at], True)
                elif held is None:
                    held = ([], ids[at], False)
                open_, more = scanner.step(open_, piece)
                depth += more
                held[0].append(scanner.clean(piece, first, open_, depth))
                first = False
        yield _rows(out)
    if held:
        yield _rows([closed(scanner.whole(open_, depth))])


def _rows(found: list) -> pa.RecordBatch:
    columns = list(zip(*[r for r in found if r is not None])) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()))],
                                      ["record", SOURCE_FILE, ROW_ID, "began"])


def _placed(pieces: DataFrame, scanner):
    """The start states of all splits, and a function that gives the pieces of some of them, in order, with their state."""
    states = durable(_start_states(pieces.mapInArrow(lambda b: _border_states(scanner, b), _BORDER_STATES)))  # one row a split
    few = states.count() <= BROADCAST_SPLITS
    placed = pieces.withColumn("split", F.shiftright(F.col(ROW_ID), _SPLIT_BITS))

    def with_states(some: DataFrame) -> DataFrame:
        chosen = some.select(SOURCE_FILE, "split", "open", "depth")
        joined = placed.join(F.broadcast(chosen) if few else chosen, [SOURCE_FILE, "split"])
        joined = joined.select("value", SOURCE_FILE, ROW_ID, "open", "depth")
        return joined if few else joined.sortWithinPartitions(SOURCE_FILE, ROW_ID)
    return states, with_states


def records(pieces: DataFrame, scanner) -> DataFrame:
    """(record, _source_file, _row_id) of (value, _source_file, _row_id), a text scan with ``with_row_order``.

    A record has the row id of its first piece. A quoted value that never ends runs to the end of its file, as one record.
    """
    states, with_states = _placed(pieces.select("value", SOURCE_FILE, ROW_ID), scanner)
    whole = with_states(states).mapInArrow(lambda b: _cut(scanner, False, b), _CUT)
    # Only splits that start or end inside a record have fragments.
    inside = states.where(~_starts(scanner, "open", "depth") | ~_starts(scanner, "open_after", "depth_after"))
    fragments = with_states(inside).mapInArrow(lambda b: _cut(scanner, True, b), _CUT)
    order = Window.partitionBy(SOURCE_FILE).orderBy(ROW_ID)
    opener = F.last(F.when(F.col("began"), F.col(ROW_ID)), ignorenulls=True).over(order)
    joined = (fragments.withColumn("opener", F.coalesce(opener, F.col(ROW_ID))).groupBy(SOURCE_FILE, "opener")
              .agg(F.array_sort(F.collect_list(F.struct(ROW_ID, "record"))).alias("parts"))
              .select(F.array_join("parts.record", scanner.joiner).alias("record"), SOURCE_FILE, F.col("opener").alias(ROW_ID)))
    return whole.select("record", SOURCE_FILE, ROW_ID).unionByName(joined)


def _starts(scanner, open_: str, depth: str):
    if isinstance(scanner, ArrayElements):
        return ~F.col(open_) & (F.col(depth) == 1)
    return ~F.col(open_)
