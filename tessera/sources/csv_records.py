"""Records of CSV files whose quoted fields hold line ends, found in parallel (A1).

A line by itself does not tell whether it begins a record: that depends on the
quotes before it.  But it is a function of two states, "a quoted field is open" or
not, to two states, and such functions compose.  So

1. every byte range of a file composes its lines' functions in one pass;
2. a running composition over the ranges of each file (a row per range) gives the
   state in which every range begins;
3. a second pass cuts every range into records, knowing its first state; only the
   pieces of records that go over the border of a range are shuffled and joined.

The rules are those of RFC 4180 as read leniently: a field is quoted if its first
character is a quote, a doubled quote inside is one quote, whatever stands between the
closing quote and the comma belongs to the field, and quotes inside an unquoted field are
ordinary.  Records end with ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A quoted field that is closed, at the start of a line or after a comma (doubled quotes taken out before).
CLOSED = '(^|,)"[^"]*+"[^,]*+'
#: What is left of a line up to the end of the field that was open before it.
CLOSING = '^[^"]*+"[^,]*+'


def line_states(line: Column) -> tuple[Column, Column]:
    """Whether a quoted field is open after the line, if none was open before it, and if one was."""
    single = F.replace(line, F.lit('""'), F.lit(""))
    opens = lambda rest: F.regexp_replace(rest, CLOSED, "$1").rlike('(^|,)"')
    quoted = F.contains(line, F.lit('"'))
    return (F.when(quoted, opens(single)).otherwise(False),
            F.when(F.contains(single, F.lit('"')), opens(F.regexp_replace(single, CLOSING, ""))).otherwise(True))


def _lines(spark: SparkSession, path, encoding: str) -> DataFrame:
    """``(file, block, line, out, in)`` in the order of each file's byte ranges."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value")
    if encoding.upper() != "UTF-8":
        line = F.decode(line.cast("binary"), encoding)       # the reader hands on the bytes
    line = F.when(F.startswith(line, F.lit("﻿")), F.substr(line, F.lit(2))).otherwise(line)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       line.alias("line"))
    after_out, after_in = line_states(F.col("line"))
    return lines.select("file", "block", "line", after_out.alias("out"), after_in.alias("in"))


def states_before(out: np.ndarray, in_: np.ndarray, first: bool) -> np.ndarray:
    """State before each line of a run, and after the last one (True: a quoted field is open).

    A line either sets the state, keeps it or turns it over; the state is what the last
    setting line left, turned over as often as a line has done so since."""
    sets, turns = out == in_, out & ~in_
    n = len(out)
    turned = np.r_[0, np.cumsum(turns)]
    last = np.maximum.accumulate(np.r_[0, np.where(sets, np.arange(1, n + 1), 0)])
    value = np.r_[first, out][last]
    return value ^ ((turned - turned[last]) % 2 == 1)


def _runs(batch: pa.RecordBatch):
    """Slices of a batch that belong to one range of one file."""
    block = batch.column("block").to_numpy(zero_copy_only=False)
    file = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    border = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
    for a, b in zip(np.r_[0, border].tolist(), np.r_[border, len(block)].tolist()):
        if b > a:
            yield batch.column("file")[a].as_py(), int(block[a]), batch.slice(a, b - a)


def _functions(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(run.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("out", "in"))


def _ranges(batches):
    """``(file, block, out, in)`` of every range: its lines' functions one after the other."""
    key, state, found = None, None, []
    for batch in batches:
        for file, block, run in _runs(batch):
            if key != (file, block):
                if key:
                    found.append((*key, *state))
                key, state = (file, block), (False, True)
            functions = _functions(run)
            state = tuple(bool(states_before(*functions, s)[-1]) for s in state)
    if key:
        found.append((*key, *state))
    columns = list(zip(*found)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["file", "block", "out", "in"])


def _open_ranges(lines: DataFrame) -> DataFrame:
    """``(file, block)`` of the ranges that begin inside a quoted field."""
    ranges = lines.select("file", "block", "out", "in").mapInArrow(
        _ranges, "file string, block long, out boolean, in boolean")
    order = Window.partitionBy("file").orderBy("block")          # a row for each range of the file
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum((F.col("out") & ~F.col("in")).cast("int"))
    at = ranges.withColumn("turned", turns.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    set_ = F.last(F.when(F.col("out") == F.col("in"), F.struct("out", "turned")), ignorenulls=True)
    at = at.withColumn("set", set_.over(before)).withColumn("until", F.coalesce(F.lag("turned").over(order), F.lit(0)))
    odd = (F.col("until") - F.coalesce("set.turned", F.lit(0))) % 2 == 1
    return at.where(F.coalesce("set.out", F.lit(False)) != odd).select("file", "block")


def _cut(batches):
    """``(file, block, first, piece, text)``: records (piece 0) and pieces of records that began
    in an earlier range (1) or go on in a later one (2); ``first`` is a file's first record."""
    names = ["file", "block", "first", "piece", "text"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int8(), pa.string())
    key, state, held, begun, fresh = None, False, [], False, False

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def rest():
        """What is open at the end of a range."""
        if key and held:
            yield table([(*key, fresh and begun, 2 if begun else 1, "\n".join(held))])

    for batch in batches:
        for file, block, run in _runs(batch):
            if key != (file, block):
                yield from rest()
                state = run.column("open")[0].as_py()
                key, held, begun, fresh = (file, block), [], not state, block == 0
            before = states_before(*_functions(run), state)
            starts, state = ~before[:-1], bool(before[-1])
            line = run.column("line")
            # lines that are records by themselves pass as they are
            whole = starts & ~before[1:]
            if whole.all() and not held:
                out = [(*key, fresh, 0, line[0].as_py())] if fresh else []
                if out:
                    yield table(out)
                line = line.slice(len(out))
                fresh = False
                if len(line):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(line), pa.string()), pa.array([block] * len(line), pa.int64()),
                         pa.array([False] * len(line)), pa.array([0] * len(line), pa.int8()), line], names=names)
                continue
            rows = []
            for text, opened in zip(line.to_pylist(), before[1:].tolist()):
                held.append(text)
                if not opened:
                    rows.append((*key, fresh and begun, 0 if begun else 1, "\n".join(held)))
                    fresh, held, begun = fresh and not begun, [], True
            if rows:
                yield table(rows)
    yield from rest()


def records(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """``(file, first, text)``: every record of the files, line ends inside quotes kept.

    ``first`` marks the first record of a file (its header)."""
    from ..operators.split import bounded
    lines = _lines(spark, path, encoding)
    inside = _open_ranges(lines).withColumn("open", F.lit(True)).checkpoint()
    small = bounded(inside, inside.count())
    if small is inside:            # too many to broadcast: a shuffle join, then the order of the lines again
        at = lines.withColumn("at", F.monotonically_increasing_id()).join(inside, ["file", "block"], "left")
        lines = at.repartition("file", "block").sortWithinPartitions("file", "block", "at").drop("at")
    else:                          # a broadcast join keeps the order of the lines
        lines = lines.join(small, ["file", "block"], "left")
    cut = lines.select("file", "block", "line", "out", "in", F.coalesce("open", F.lit(False)).alias("open")).mapInArrow(
        _cut, "file string, block long, first boolean, piece tinyint, text string")
    # a range has at most one piece at its start and one at its end; joined now, not by every later job
    order = Window.partitionBy("file").orderBy("block", "piece")
    pieces = cut.where("piece > 0").withColumn("record", F.sum((F.col("piece") == 2).cast("int")).over(order))
    joined = pieces.groupBy("file", "record").agg(
        F.max("first").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))),
                                 lambda p: p["text"]), "\n").alias("text")).checkpoint()
    out = cut.where("piece = 0").select("file", "first", "text").unionByName(joined.select("file", "first", "text"))
    return out.select("file", "first", F.regexp_replace("text", r"\r\z", "").alias("text")).where(F.length("text") > 0)
