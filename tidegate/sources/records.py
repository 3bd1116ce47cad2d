"""Records that go over lines or splits, read in parallel: CSV with line ends in cells, JSON arrays.

A file is read by Spark's text reader in pieces that end at a separator (a line feed; a closing brace
for JSON), from all splits at once. Whether a piece ends a record depends on what stands before it:
whether its start lies in a quoted text, and how deep it is nested. So each piece is a small function
from the state at its start to the state at its end, for either start, which column functions work out
for the piece alone. Three steps follow:

1. One pass composes the functions of every split: one row per split.
2. The functions of the splits of a file, in turn, give the state in which each split starts. This is
   done on the driver, for files of several splits only: a row per split.
3. With that, each task cuts its splits into records. A record that goes over the end of a split
   leaves a part in either; the parts, two per split at most, are put together by a small shuffle.
"""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.scratch import scratch_path

#: What is known of a piece: does it end within quotes if it starts outside (inside) of them, and
#: how much deeper does it end.
_STEP = ["ends0", "ends1", "deeper0", "deeper1"]
_PLACE = ["file", "block"]


@dataclass(frozen=True)
class Grammar:
    """How pieces make records.

    ``step`` gives the columns of _STEP for a piece of text. A record ends with a piece that ends
    outside of quotes at ``depth``. ``closing`` belongs to the record. ``lead`` and ``between`` match
    what stands in front of the first record and of others, ``tail`` what may follow the last one;
    without ``tail``, what is left at the end of a file is a record too, and blank records are left out.
    """

    separator: str
    step: Callable[[Column], list[Column]]
    depth: int = 0
    closing: str = ""
    lead: str = ""
    between: str = ""
    tail: str | None = None


def lines_grammar() -> Grammar:
    """Every line is a record."""
    return Grammar("\n", lambda _: [F.lit(False), F.lit(False), F.lit(0), F.lit(0)])


def wide_lines_grammar(little: bool) -> Grammar:
    """Lines of UTF-16: what is inside here is a place in the midst of a character.

    The bytes of a line feed only are one if an even number of bytes stands before them.
    """

    def step(piece: Column) -> list[Column]:
        odd = F.octet_length(piece.cast("binary")) % 2 == 1
        return [odd, ~odd, F.lit(0), F.lit(0)]

    return Grammar("\n\0" if little else "\0\n", step)


def opens_cell(line: Column, sep: str = ",") -> Column:
    """Whether a CSV line that starts a record ends within a quoted cell.

    A quote opens a cell only at its start; two quotes in a quoted cell are one; what follows the
    closing quote up to the next separator is part of the cell, as in Spark's own CSV reader.
    """
    s = re.escape(sep)
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    pattern = f'^(?:(?:{quoted}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+{quoted}\\z'
    return F.contains(line, F.lit('"')) & line.rlike(pattern)


def csv_grammar(sep: str = ",") -> Grammar:
    """Records of a CSV file with ``"`` as the quote, and as its escape."""

    def step(line: Column) -> list[Column]:
        inside = ~F.contains(line, F.lit('"')) | opens_cell(F.concat(F.lit('"'), line), sep)
        return [opens_cell(line, sep), inside, F.lit(0), F.lit(0)]

    return Grammar("\n", step)


def json_grammar() -> Grammar:
    """The objects of one array."""

    def count(text: Column, characters: str) -> Column:
        return F.length(text) - F.length(F.translate(text, characters, ""))

    def step(piece: Column) -> list[Column]:
        # Without escapes every quote opens or closes a text.
        plain = F.regexp_replace(piece, r"(?s)\\.", "")
        odd = count(plain, '"') % 2 == 1
        columns = []
        for start, inside in (("", odd), ('"', ~odd)):
            bare = F.regexp_replace(F.concat(F.lit(start), plain), r'"[^"]*+(?:"|\z)', "")
            # The brace that ends the piece counts where it is not part of a text.
            brace = F.when(inside, 0).otherwise(1)
            columns.append((count(bare, "{[") - count(bare, "}]") - brace).cast("int"))
        return [odd, ~odd, *columns]

    space = r"[ \t\r\n]*"
    return Grammar(
        "}", step, 1, "}", rf"[﻿\x00 \t\r\n]*\[{space}(?=\{{)", rf"{space},{space}(?=\{{)",
        rf"[﻿\x00 \t\r\n]*\[?{space}\]{space}",
    )


def _pieces(spark: SparkSession, paths: str | list[str], grammar: Grammar, options: dict) -> DataFrame:
    text = spark.read.options(**options).option("lineSep", grammar.separator).text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
        *(c.alias(name) for c, name in zip(grammar.step(F.col("value")), _STEP)),
    )


def _inside(ends0: np.ndarray, ends1: np.ndarray, start: bool) -> np.ndarray:
    """Whether each piece ends within quotes: the last piece that fixes it, and changes since."""
    fixed = np.where(ends0 == ends1, np.arange(1, len(ends0) + 1), 0)
    last = np.maximum.accumulate(fixed)
    changes = np.r_[0, np.cumsum(ends0 & ~ends1)]
    base = np.where(last > 0, ends0[last - 1], start)
    return base ^ ((changes[1:] - changes[last]) % 2 == 1)


def _ends(batch: pa.RecordBatch, start: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """State behind each piece: within quotes, and the depth."""
    ends0, ends1, deeper0, deeper1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in _STEP)
    inside = _inside(ends0, ends1, start)
    before = np.r_[start, inside[:-1]]
    return inside, depth + np.cumsum(np.where(before, deeper1, deeper0))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Parts of the batches that lie within one split, with its place."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = [batch.column(c).dictionary_encode() for c in _PLACE]
        codes = [p.indices.to_numpy(zero_copy_only=False) for p in place]
        new = (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])
        edges = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            yield tuple(batch.column(c)[low].as_py() for c in _PLACE), batch.slice(low, high - low)


_SPLIT = "file string, block long, ends0 boolean, ends1 boolean, deeper0 long, deeper1 long, least0 long, least1 long"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its step, and the least depth at which a piece of it ends outside of quotes."""
    place, states, least = None, None, None

    def row() -> pa.RecordBatch:
        (end0, deep0), (end1, deep1) = states
        values = [*place, end0, end1, deep0, deep1, *least]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4)
        names = ["file", "block", *_STEP, "least0", "least1"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    for here, part in _runs(batches):
        if here != place:
            if place:
                yield row()
            place, states, least = here, [(False, 0), (True, 0)], [None, None]
        for i, (start, depth) in enumerate(states):
            inside, depths = _ends(part, start, depth)
            states[i] = (bool(inside[-1]), int(depths[-1]))
            if not inside.all():
                low = int(depths[~inside].min())
                least[i] = low if least[i] is None else min(least[i], low)
    if place:
        yield row()


@dataclass(frozen=True)
class _Start:
    """How a split starts; ``opener`` is the split in which the record began that goes on in it."""

    inside: bool
    depth: int
    opener: int | None
    last: bool


def _starts(splits: list, depth: int) -> dict[tuple[str, int], _Start]:
    """The starts of the splits of each file, given in their order."""
    found, file = {}, None
    for i, split in enumerate(splits):
        if split.file != file:
            file, inside, deep, opener = split.file, False, 0, None
        last = i + 1 == len(splits) or splits[i + 1].file != file
        found[split.file, split.block] = _Start(inside, deep, opener, last)
        ends, deeper, least = (
            (split.ends1, split.deeper1, split.least1) if inside else (split.ends0, split.deeper0, split.least0)
        )
        ended = least is not None and deep + least <= depth
        inside, deep = ends, deep + deeper
        # The record that is open behind this split began in it, unless none ended here.
        if not inside and deep == depth:
            opener = None
        elif ended or opener is None:
            opener = split.block
    return found


_CUT = "file string, block long, row long, record string, part long, data binary"


@dataclass(frozen=True)
class _Reading:
    """How the bytes of records become texts, and whether blank ones stay out."""

    charset: str
    errors: str
    skip_blank: bool

    @property
    def returns(self) -> bytes:
        return "\r".encode(self.charset)

    def blank(self, record: bytes) -> bool:
        return self.skip_blank and record.removesuffix(self.returns) == b""


def _cutter(grammar: Grammar, reading: _Reading, starts: Broadcast | None):
    """A function for tasks that makes records, and parts of those that go over the end of a split.

    A part has the place of the split in which its record began, ``part``, the split it is in itself,
    and its bytes in ``data``.
    """
    separator, finished = grammar.separator.encode(), _finisher(grammar, reading)
    tail = None if grammar.tail is None else _compiled(grammar.tail)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = starts.value if starts else {}
        place = start = opener = None
        held: list[bytes] = []
        row, inside, deep = 0, False, 0

        def one(record: bytes | None) -> tuple:
            return *place, row, finished(record, place[1] == 0 and row == 0), None, None

        def rest() -> Iterator[tuple]:
            """What the last split leaves behind its last record."""
            file, block = place
            left = separator.join(held)
            if opener is not None:
                yield file, opener, None, None, block, left
            elif start.last and tail is not None:
                if not tail.fullmatch(left):
                    raise ValueError(f"{file} ends with {left[-200:]!r}.")
            elif held and start.last:
                # What is left ends with the file, or in the midst of a character.
                yield one(left)
            elif held:
                yield file, block, row, None, block, left

        for here, part in _runs(batches):
            if here != place:
                if place:
                    yield from rest()
                place, start = here, known.get(here)
                if start is None:
                    if here[1] > 0:
                        raise ValueError("The splits of a file changed between two scans; run again.")
                    start = _Start(False, 0, None, True)
                held, row, inside, deep, opener = [], 0, start.inside, start.depth, start.opener
            quoted, depths = _ends(part, inside, deep)
            inside, deep = bool(quoted[-1]), int(depths[-1])
            values, at = part.column("value").to_pylist(), 0
            for end in np.flatnonzero(~quoted & (depths == grammar.depth)).tolist():
                record = separator.join([*held, *values[at : end + 1]])
                held, at = [], end + 1
                if opener is not None:
                    yield here[0], opener, None, None, here[1], record
                    opener = None
                elif tail is not None or not reading.blank(record):
                    yield one(record)
                    row += 1
            held += values[at:]
        if place:
            yield from rest()

    return lambda batches: _as_batches(cut(batches))


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.encode())


def _finisher(grammar: Grammar, reading: _Reading) -> Callable[[bytes, bool], str]:
    """The text of a record from its bytes, without what stands in front of it."""
    lead, between, closing = _compiled(grammar.lead), _compiled(grammar.between), grammar.closing.encode()

    def finished(record: bytes, first: bool) -> str:
        record += closing
        front = (lead if first else between).match(record)
        if front is None:
            raise ValueError(f"Malformed record: {record[:200]!r}")
        if grammar.tail is None:
            record = record.removesuffix(reading.returns)
        return record[front.end() :].decode(reading.charset, reading.errors)

    return finished


def _as_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    names = ["file", "block", "row", "record", "part", "data"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    for row in rows:
        held.append(row)
        size += len(row[3] or row[5] or "")
        if len(held) >= 10_000 or size > 16 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _joined(grammar: Grammar, reading: _Reading):
    """A function for tasks that puts the sorted parts of records together."""
    separator, finished = grammar.separator.encode(), _finisher(grammar, reading)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                record = separator.join(part["data"] for part in r["parts"])
                if not reading.blank(record):
                    yield r["file"], r["block"], r["row"], finished(record, r["block"] == r["row"] == 0), None, None

    return lambda batches: _as_batches(join(batches))


def opens_any_cell(spark: SparkSession, paths: str | list[str], sep: str, options: dict) -> bool:
    """Whether some CSV record goes on in the next line. The scan ends at the first hit."""
    lines = spark.read.options(**options).option("lineSep", "\n").text(paths)
    return not lines.filter(opens_cell(F.col("value"), sep)).isEmpty()


def read_records(
    spark: SparkSession,
    paths: str | list[str],
    grammar: Grammar,
    charset: str = "utf-8",
    skip_blank: bool = True,
    errors: str = "strict",
    **options,
) -> DataFrame:
    """``(file, block, row, record)``: the records of all files, in order by ``block`` and ``row``.

    ``charset`` is one in which the bytes of ASCII characters stand for nothing else, or that of the
    grammar; a byte that is not valid in it fails the job unless ``errors`` is ``replace``, as do records
    of another form than the grammar's. Blank records are left out, or kept if not ``skip_blank``. The
    splits are those of Spark's text reader, whose options for files are taken. A record has to fit into a cell.

    One scan is done at once, and another one if files have several splits; the rest is lazy.
    """
    pieces = _pieces(spark, paths, grammar, options)
    splits = pieces.select(*_PLACE, *_STEP).mapInArrow(_composed, _SPLIT)
    several = splits.withColumn("splits", F.expr("count(*) OVER (PARTITION BY file)")).filter("splits > 1")
    starts = _starts(several.orderBy("file", "block").collect(), grammar.depth)
    shared = spark.sparkContext.broadcast(starts) if starts else None
    cut = pieces.select(*_PLACE, "value", *_STEP).mapInArrow(_cutter(grammar, _Reading(charset, errors, skip_blank), shared), _CUT)
    found = cut.filter("part IS NULL").select("file", "block", "row", "record")
    if not any(s.opener is not None for s in starts.values()):
        return found
    path = scratch_path(spark, "record-parts")
    cut.filter("part IS NOT NULL").drop("record").write.parquet(path)
    parts = spark.read.schema("file string, block long, row long, part long, data binary").parquet(path)
    together = (
        parts.groupBy("file", "block")
        .agg(F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("part", "data"))).alias("parts"))
        .mapInArrow(_joined(grammar, _Reading(charset, errors, skip_blank)), _CUT)
    )
    return found.unionByName(together.select("file", "block", "row", "record"))
