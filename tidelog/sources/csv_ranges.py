"""CSV rows out of one file by many tasks, though quoted fields hold line ends.

Where a byte range begins, nothing tells whether that is inside a quoted field.  So each range is scanned for both cases at once: every
line is a step from (outside, inside) to (outside, inside), and a range reports where either start leads and how many rows would start
in it.  The reports, one small row for each range, are put together from the first range on, which starts outside; that fixes for
every range how it begins and the number of its first row.  The second scan then puts lines together to rows; only rows that go over the
edge of a range are shuffled.

A line step follows the fields, not just the count of quotes: a quote inside an unquoted field is a plain character, and what follows a closing quote up
to the comma belongs to the field.  Lines end with a line feed, or with a carriage return and line feed where the header's do (read as a line feed, also inside quotes); blank rows do not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import durable
from tidelog.errors import TidelogError
from tidelog.workers import reach

# a quoted value up to the quote that is not doubled; what may follow it; fields that are complete
_INNER = r'[^"]*+(?:""[^"]*+)*+'
_TAIL = r"[^,]*+"
_FIELD = rf'(?:"{_INNER}"{_TAIL}|(?!"){_TAIL})'
_OPENING = rf'(?:{_FIELD},)*+"{_INNER}'
#: A line that starts outside and ends inside; one that starts inside and ends there, as it never closes the value or opens another.
OPENS = rf"(?s)\A{_OPENING}\z"
STAYS = rf'(?s)\A{_INNER}(?:"{_TAIL},{_OPENING})?\z'

_REPORT = "file string, start long, size long, end0 boolean, end1 boolean, rows0 long, rows1 long, returns boolean"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    place = [F.col(f"_metadata.file_{x}").alias(y) for x, y in (("path", "file"), ("block_start", "start"), ("block_length", "size"))]
    return text.select("value", *place, F.col("value").rlike(OPENS).alias("opens"), F.col("value").rlike(STAYS).alias("stays"))


def _states(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line begins inside, and the state after the last, for a first line that begins as told."""
    same = opens == stays  # the line ends in one state whatever it began in
    swaps = opens & ~stays
    flips = np.cumsum(swaps)
    last = np.maximum.accumulate(np.where(same, np.arange(len(same)), -1))
    fixed = last >= 0
    at = np.maximum(last, 0)
    base = np.where(fixed, opens[at], inside)
    after = base ^ ((flips - np.where(fixed, flips[at], 0)) % 2 == 1)
    return np.concatenate(([inside], after))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int, int], pa.RecordBatch]]:
    """Runs of lines of one range."""
    if not batch.num_rows:
        return
    starts = batch.column("start").to_numpy(zero_copy_only=False)
    files = pc.rank(batch.column("file"), "ascending", tiebreaker="dense").to_numpy(zero_copy_only=False)
    edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(files.astype(np.int64)) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(starts)], strict=True):
        yield (batch.column("file")[a].as_py(), int(starts[a]), batch.column("size")[a].as_py()), batch.slice(a, b - a)


def _flags(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = pc.match_substring_regex(piece.column("value"), r"^\r?$").to_numpy(zero_copy_only=False)
    return piece.column("opens").to_numpy(zero_copy_only=False), piece.column("stays").to_numpy(zero_copy_only=False), blank


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, told = None, []

    def out() -> pa.RecordBatch:
        names = [x.split()[0] for x in _REPORT.split(", ")]
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, *told), strict=True))], schema=pa.schema([(n, t) for n, t in zip(names, (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]))

    for batch in batches:
        for k, piece in _pieces(batch):
            if k != key:
                if key is not None:
                    yield out()
                key, told = k, [False, True, 0, 0, piece.column("value")[0].as_py().endswith("\r")]
            opens, stays, blank = _flags(piece)
            for case in (0, 1):
                states = _states(opens, stays, bool(told[case]))
                told[2 + case] += int((~states[:-1] & ~blank).sum())
                told[case] = bool(states[-1])
    if key is not None:
        yield out()


class Place(NamedTuple):
    """How a range begins: inside a row or not, that row's number, the number of its first own row, whether that is a header, whether lines end with a carriage return."""

    inside: bool
    open_row: int
    next_row: int
    header: bool
    returns: bool


HEADER = -1


def _places(reports: list) -> dict[tuple[str, int, int], Place]:
    out: dict[tuple[str, int, int], Place] = {}
    n, open_row, file, inside, header, returns = 0, HEADER, None, False, True, False
    for r in sorted(reports, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, inside, header, returns = r.file, False, True, r.returns
        out[(r.file, r.start, r.size)] = Place(inside, open_row, n, header, returns)
        started = r.rows1 if inside else r.rows0
        if started:
            n += started - header
            open_row = HEADER if header and started == 1 else n - 1
            header = False
        inside = r.end1 if inside else r.end0
    return out


def rows(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """``row, text``: the rows of a CSV file (or of several, one after the other by path) without headers, numbered from 0.

    Ranges are as Spark cuts the files; they are looked at twice, and an error tells if the second scan is cut otherwise.  With
    ``range_bytes`` files are cut at that size, and the rows are written at once.
    """
    if range_bytes is None:
        return _rows(spark, path)
    sizes = {"spark.sql.files.maxPartitionBytes": range_bytes, "spark.sql.files.openCostInBytes": 1}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        return durable.written(_rows(spark, path))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(reach(spark), path)
    places = spark.sparkContext.broadcast(_places(lines.mapInArrow(_report, _REPORT).collect()))  # a row for each range

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, row, next_row, header, returns, held, head = None, False, HEADER, 0, False, False, [], False
        out: list[tuple] = []

        def close(whole: bool) -> None:
            if held:
                text = "\n".join(held)
                out.append((row, not whole or head, key[1], text))
                held.clear()

        def flush(force: bool) -> Iterator[pa.RecordBatch]:
            if out and (force or len(out) >= 4096):
                columns = list(zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["row", "part", "start", "text"])

        for batch in batches:
            for k, piece in _pieces(batch):
                if k != key:
                    close(False)  # goes on in the next range
                    if k not in places.value:
                        raise TidelogError("INGEST_CSV_RANGES_CHANGED", "The file is cut otherwise than before", str(k))
                    key, (inside, row, next_row, header, returns) = k, places.value[k]
                    head = inside
                opens, stays, blank = _flags(piece)
                states = _states(opens, stays, inside)
                texts = piece.column("value").to_pylist()
                for text, begins_inside, ends_inside, empty in zip(texts, states[:-1].tolist(), states[1:].tolist(), blank.tolist(), strict=True):
                    if not begins_inside:
                        if empty:
                            continue
                        row, next_row, header = (HEADER, next_row, False) if header else (next_row, next_row + 1, False)
                    held.append(text[:-1] if returns and text.endswith("\r") else text)
                    if not ends_inside:
                        close(True)
                        head = False
                inside = bool(states[-1])
                yield from flush(False)
        close(False)
        yield from flush(True)

    made = lines.mapInArrow(assemble, "row long, part boolean, start long, text string").filter(F.col("row") != HEADER)
    whole = made.filter("not part").select("row", "text")
    parts = made.filter("part").groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x.text), "\n").alias("text"))
    return whole.unionByName(parts)


def fields(text: Column, names: list[str], bad: str | None) -> Column:
    """A row's fields as a struct of texts; rows of another width carry themselves in ``bad``."""
    schema = ", ".join(f"`{n}` string" for n in [*names, *([bad] if bad else [])])
    options = {"multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE" if bad else "FAILFAST"} | ({"columnNameOfCorruptRecord": bad} if bad else {})
    return F.from_csv(text, schema, options)
