"""CSV files of any size, read in parallel whatever their fields hold.

Spark cuts a text file into byte ranges and hands each its lines. A line end within a quoted field ends no record, and whether it is
one depends on all quotes before it. So every range first says what its lines do to both states that it may begin in (between
records, or within a quoted field): the state that it ends in, and whether a record ended on the way. Only lines with a quote can
change a state, so only these leave the JVM, and a range's answer is two bits for each beginning. From the answers in order follows
each range's true beginning. If no record has a line end within, Spark's own CSV reader takes the file, split as it is. Else ranges
put their lines together to records by themselves, and the pieces of records that cross a range's end are joined by the place where
the record begins.

A quote counts as one only where a field begins; one within an unquoted field is a character like any other. Quotes within quoted
fields are doubled. The driver gets one row for each range that has a quote, and has scheduled a task for each anyway.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.config import PLACE

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_BROKEN = "__broken"
_ANSWERS = ("after0", "after1", "back", "opens", "bare", "unlike")
#: Stretches of ranges with pieces beyond which all ranges are asked for pieces: a longer condition costs more than it saves.
STRETCHES = 100


def ends_within(line: str, within: bool, sep: str) -> bool:
    """Whether a line ends within a quoted field; within: whether it begins in one."""
    at = 0
    if within or line[:1] == '"':
        at = _QUOTED.match(line, 0 if within else 1).end()
        if at >= len(line):
            return True
    while (at := line.find(sep + '"', at)) >= 0:
        at = _QUOTED.match(line, at + 2).end()
        if at >= len(line):
            return True
    return False


def _answers(sep: str, encoding: str):
    """From lines with quotes, in order: what each range does to both states. after0, after1: whether it ends within a field, if it
    begins between records or within a field; back: whether a record that is open at its beginning ends in it; opens: whether a line
    that begins between records ends within a field; bare: whether a line has a carriage return that isn't at its end; unlike: whether
    a line is not of the encoding."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], list] = {}
        for batch in batches:
            for file, start, raw, bare in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line", "bare")), strict=True):
                now = done.setdefault((file, start), [False, True, False, False, False, False])
                try:
                    line = raw.decode(encoding)
                except UnicodeDecodeError:
                    now[5], line = True, raw.decode(encoding, "replace")
                line = line.removeprefix("\ufeff") if start == 0 else line
                opens, stays = ends_within(line, False, sep), ends_within(line, True, sep)
                now[0], now[1] = (stays if now[0] else opens), (stays if now[1] else opens)
                now[2], now[3], now[4] = now[2] or not now[1], now[3] or opens, now[4] or bare
        place = [pa.array([k[0] for k in done], pa.string()), pa.array([k[1] for k in done], pa.int64())]
        yield pa.RecordBatch.from_arrays([*place, *(pa.array([v[k] for v in done.values()], pa.bool_()) for k in range(6))], ["file", "start", *_ANSWERS])

    return run


@dataclass(frozen=True)
class Marks:
    """Of one file. starts: ranges after which the state changes or the open record does; owners: for each of them the range in which the record that
    is open at its end begins, or -1 for none."""

    starts: tuple[int, ...]
    owners: tuple[int, ...]

    def at(self, start: int) -> int:
        """The range where the record begins that is open when a range does; -1 if none is."""
        k = bisect.bisect_left(self.starts, start)
        return self.owners[k - 1] if k else -1

    @property
    def last(self) -> int:
        return self.owners[-1] if self.owners else -1


_NONE = Marks((), ())


def marks(answers: list[tuple[int, bool, bool, bool]]) -> Marks:
    """From (start, after0, after1, back) of a file's ranges that have a quote."""
    starts, owners, owner = [], [], -1
    for start, after0, after1, back in sorted(answers):
        inside = after1 if owner >= 0 else after0
        now = -1 if not inside else owner if owner >= 0 and not back else start
        if now != owner:
            starts.append(start)
            owners.append(now)
            owner = now
    return Marks(tuple(starts), tuple(owners))


def _records(sep: str, encoding: str, found: dict[str, Marks]):
    """Lines, in order, to records, but for one that is open at a file's end. owner, row: the range that the record begins in, and its
    number there; start: this range; whole: whether the record is complete here. found: of the files that have quoted line ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["file", "owner", "row", "start", "whole", "record"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        made: list[tuple] = []
        name, here, own, owner, row, parts, within, crosses = None, None, _NONE, -1, 0, [], False, False

        def piece() -> None:
            """What there is of a record that other ranges have the rest of."""
            if parts and owner != own.last:
                made.append((name, owner, row if owner == here else 0, here, False, "\n".join(parts)))

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names)
            made.clear()
            return out

        for batch in batches:
            size = 0
            for file, start, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "line")), strict=True):
                if start != here or file != name:
                    piece()
                    name, here, own = file, start, found.get(file, _NONE)
                    owner = own.at(start)
                    within = crosses = owner >= 0
                    parts, row = [], 0
                line = raw.decode(encoding, "replace")
                if start == 0 and row == 0 and not parts:
                    line = line.removeprefix("﻿")
                if not parts and not within:
                    owner, row = here, row + 1
                within = ends_within(line, within, sep) if '"' in line else within
                if not within and line.endswith("\r"):
                    line = line[:-1]
                parts.append(line)
                if not within:
                    if crosses:
                        piece()
                    elif parts == [""]:  # an empty line is no record
                        row -= 1
                    else:
                        made.append((name, owner, row, here, True, parts[0] if len(parts) == 1 else "\n".join(parts)))
                    parts, crosses = [], False
                size += len(line)
                if size > 1 << 22:
                    yield table()
                    size = 0
            if made:
                yield table()
        piece()
        if made:
            yield table()

    return run


def _with_pieces(found: dict[str, Marks]) -> Column:
    """Ranges that begin or end within a record."""
    stretches: list[list] = []
    for file, own in found.items():
        for a, b, owner in zip(own.starts, [*own.starts[1:], None], own.owners, strict=True):
            if owner >= 0:  # from the range after which a record is open to the one in which it ends
                if stretches and stretches[-1][0] == file and stretches[-1][2] == a:
                    stretches[-1][2] = b
                else:
                    stretches.append([file, a, b])
    out = F.lit(len(stretches) > STRETCHES)
    for file, a, b in stretches if len(stretches) <= STRETCHES else []:
        out = out | (F.col("file") == file) & (F.col("start") >= a) & (F.lit(True) if b is None else F.col("start") <= b)
    return out


def _split_records(lines: DataFrame, sep: str, encoding: str, found: dict[str, Marks]) -> DataFrame:
    """The place and text of every record but each file's first, which is the heading, and but one that its end breaks off."""
    raw = lines.select("file", "start", F.col("value").cast("binary").alias("line"))
    schema = "file string, owner long, row long, start long, whole boolean, record string"
    split = _records(sep, encoding, found)
    own = raw.mapInArrow(split, schema).filter("whole").select("file", "owner", "row", "record")
    if found:
        pieces = raw.filter(_with_pieces(found)).mapInArrow(split, schema).filter("NOT whole")
        joined = pieces.groupBy("file", "owner").agg(F.max("row").alias("row"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"))
        own = own.unionByName(joined.select("file", "owner", "row", F.concat_ws("\n", F.col("p.record")).alias("record")))
    return own.filter("owner <> 0 OR row <> 1").select(*[F.col(c).alias(p) for c, p in zip(("file", "owner", "row"), PLACE, strict=True)], "record")


@dataclass(frozen=True)
class Scan:
    """The records below the heading. cells: c0, c1 ... as text, the empty ones null, and the records' place (PLACE) among the files;
    records with more or fewer cells than the heading are left out. parsed: all records, the text of those left out in one more column."""

    cells: DataFrame
    parsed: DataFrame
    encoding: str
    quoted_line_ends: bool

    def broken(self) -> int:
        """Number of records left out."""
        return self.parsed.agg(F.count(_BROKEN), F.max("c0")).first()[0]  # Spark refuses a query of the one column alone


def scan(spark: SparkSession, path: str, columns: int, sep: str = ",", encodings: Sequence[str] = ("utf-8", "latin-1")) -> Scan:
    """The records of a file, or of a folder's files, whose heading has so many cells. encodings: names that Python knows; the first that reads all lines
    that have a quote or are not UTF-8 holds, else the last."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    cr = F.instr("value", "\r")
    bare = (cr > 0) & (cr < F.char_length("value"))
    asked = lines.filter(F.contains("value", F.lit('"')) | bare | ~F.is_valid_utf8("value")).select("file", "start", F.col("value").cast("binary").alias("line"), bare.alias("bare"))
    for encoding in encodings:
        answers = asked.mapInArrow(_answers(sep, encoding), "file string, start long, " + ", ".join(f"{c} boolean" for c in _ANSWERS)).collect()
        if not any(a["unlike"] for a in answers):
            break
    names = [f"c{k}" for k in range(columns)]
    schema, own = ", ".join(f"{c} string" for c in names), [F.nullif(F.col(c), F.lit("")).alias(c) for c in names]
    options = {"sep": sep, "quote": '"', "escape": '"', "columnNameOfCorruptRecord": _BROKEN, "columnPruning": "false"}
    if encoding == "utf-8" and not any(a["opens"] or a["bare"] or a["unlike"] for a in answers):
        read = lambda schema, mode: spark.read.schema(schema).options(**options, header=True, enforceSchema=True, mode=mode).csv(path)
        place = [c.alias(p) for c, p in zip((F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()), PLACE, strict=True)]
        return Scan(read(schema, "DROPMALFORMED").select(*own, *place), read(f"{schema}, {_BROKEN} string", "PERMISSIVE"), encoding, False)
    by_file: dict[str, list] = {}
    for a in answers:
        by_file.setdefault(a["file"], []).append((a["start"], a["after0"], a["after1"], a["back"]))
    found = {file: own for file, own in ((f, marks(rows)) for f, rows in by_file.items()) if own.starts}
    records = _split_records(lines, sep, encoding, found)
    parsed = records.select(F.from_csv("record", f"{schema}, {_BROKEN} string", options | {"multiLine": "true"}).alias("c"), *PLACE).select("c.*", *PLACE)
    return Scan(parsed.filter(f"{_BROKEN} IS NULL").select(*own, *PLACE), parsed, encoding, any(a["opens"] for a in answers))
