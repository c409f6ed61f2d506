"""History logs of any size, read in splits; what a line belongs to is carried from split to split.

A log is the text that ``patches`` describes, as one file or as files of one folder in order of their names.  A commit
is no row here: its lines may lie in many splits.  Each split is read by itself and knows the commit and file of the
lines after its first headers.  One row a split tells what it leaves to the next ones; a prefix over those rows, which
are few, gives every split what it starts with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keysift.plans.settle import settle
from keysift.sources.patches import _BLANKS, _OTHER_ENDS, COMMIT_CHARS

_ENDS = re.compile(_OTHER_ENDS)
_QUOTE_END = re.compile(r'"\s*$')
_META = ("commit", "author", "date")
_LINES = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("rec", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("open", pa.bool_()),
     ("name", pa.string()), *((c, pa.string()) for c in _META), ("line", pa.string())]
)
_LINES_DDL = (
    "file STRING, block BIGINT, rec BIGINT, part INT, at BIGINT, open BOOLEAN, name STRING, commit STRING, author STRING, "
    "date STRING, line STRING"
)
_LEFT = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), *((c, pa.int64()) for c in ("records", "headers", "lines", "header_mark", "line_mark")),
     ("name", pa.string()), *((c, pa.string()) for c in _META)]
)
_LEFT_DDL = (
    "file STRING, block BIGINT, records BIGINT, headers BIGINT, lines BIGINT, header_mark BIGINT, line_mark BIGINT, name STRING, "
    "commit STRING, author STRING, date STRING"
)


@dataclass(frozen=True)
class LogKind:
    mark: str  # of a record's first line
    header: str  # of a file's first line
    unnamed: str  # file of lines before the first such line of a record
    unknown: tuple[str | None, ...]  # commit, author and date before the first record
    meta: Callable[[str], tuple | None]  # from what follows the mark; nothing keeps the values before


def _commit(text: str) -> tuple | None:
    """Commit, author and date; a header of fewer than three parts keeps those before it."""
    parts = text.split("|")
    return (parts[0][:COMMIT_CHARS], parts[1], parts[2]) if len(parts) >= 3 else None


def _stash(text: str) -> tuple:
    return (text.split(":", 1)[0].strip(_BLANKS) if ":" in text else "stash@{0}", None, None)


PATCH_LOG = LogKind("COMMIT:", r'^(?:--- "?a/|\+\+\+ "?b/)', "Unknown", ("HEAD", "Unknown", "Unknown"), _commit)
STASH_LOG = LogKind("STASH:", r'^\+\+\+ "?b/', "Stash Diff", ("stash@{0}", None, None), _stash)


def _path(header: str) -> str:
    return _QUOTE_END.sub("", header[7:]) if header[4] == '"' else header[6:].strip(_BLANKS)


def _single_lines(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines by every line end of Python's, and which of them follow a newline."""
    odd = pc.match_substring_regex(values, r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")
    if not pc.any(odd).as_py():
        return values, np.ones(len(values), bool)
    lines, first = [], []
    for value, split in zip(values.to_pylist(), odd.to_pylist()):
        # A carriage return before the newline is part of that line end.
        parts = _ENDS.split(value[:-1] if value.endswith("\r") else value) if split else [value]
        lines += parts
        first += [True] + [False] * (len(parts) - 1)
    return pa.array(lines, pa.string()), np.array(first, bool)


class _Split:
    """One split, batch after batch."""

    def __init__(self, file: str, block: int):
        self.file, self.block = file, block
        self.records = self.headers = self.lines = 0
        self.header_mark = self.line_mark = self.name = None  # headers before its last record, place of its last mark or header
        self.meta: tuple | None = None

    def take(self, values: pa.Array, kind: LogKind) -> pa.RecordBatch:
        """The added lines of the next lines, and each record's first one with a null line."""
        values, first = _single_lines(values)
        n = len(values)
        mark = pc.starts_with(values, kind.mark).to_numpy(zero_copy_only=False) & first
        header = pc.match_substring_regex(values, kind.header).to_numpy(zero_copy_only=False)
        plus = pc.starts_with(values, "+").to_numpy(zero_copy_only=False) & ~pc.starts_with(values, "+++").to_numpy(zero_copy_only=False)
        place = self.lines + np.arange(n)
        any_mark = np.maximum.accumulate(np.where(mark | header, place, -1 if self.line_mark is None else self.line_mark))
        headers = self.headers + np.cumsum(header)
        at_record = np.maximum.accumulate(np.where(mark, headers, self.header_mark or 0))
        records = self.records + np.cumsum(mark)
        # Names and meta values by how many there have been; the first is what the batch starts with.
        marked = np.flatnonzero(mark)
        metas, whole = [self.meta], np.zeros(n, bool)
        for spot in marked.tolist():
            made = kind.meta(values[spot].as_py()[len(kind.mark):])
            if made is not None:
                metas.append(made)
                whole[spot] = True
        names = [self.name, *(_path(values[spot].as_py()) for spot in np.flatnonzero(header).tolist())]
        part = headers - at_record
        named = np.where(part > 0, headers - self.headers, 0)
        inside = (records > self.records) & (part == 0)  # in a record that began here and has named no file yet
        chosen = np.flatnonzero(plus | mark)
        name = pa.array(names, pa.string()).take(pa.array(named[chosen]))
        name = pc.if_else(pa.array(inside[chosen]), pa.scalar(kind.unnamed), name)
        told = np.cumsum(whole)[chosen]
        line = pc.if_else(pa.array(mark[chosen]), pa.scalar(None, pa.string()), pc.utf8_slice_codeunits(values.take(pa.array(chosen)), 1))
        since = any_mark[chosen]
        rows = pa.RecordBatch.from_arrays(
            [pa.array([self.file] * len(chosen), pa.string()), pa.array(np.full(len(chosen), self.block)), pa.array(records[chosen]),
             pa.array(part[chosen].astype(np.int32)), pa.array(np.where(since < 0, place[chosen], place[chosen] - since)), pa.array(since < 0),
             name, *(pa.array([m and m[i] for m in metas], pa.string()).take(pa.array(told)) for i in range(3)), line],
            schema=_LINES,
        )
        if n:
            self.name = kind.unnamed if inside[-1] else names[int(named[-1])]
            self.header_mark = int(at_record[-1]) if records[-1] else None
            self.line_mark = int(any_mark[-1]) if any_mark[-1] >= 0 else None
            self.records, self.headers, self.lines, self.meta = int(records[-1]), int(headers[-1]), self.lines + n, metas[-1]
        return rows

    def left(self) -> dict:
        return {"file": self.file, "block": self.block, "records": self.records, "headers": self.headers, "lines": self.lines,
                "header_mark": self.header_mark, "line_mark": self.line_mark, "name": self.name,
                **dict(zip(_META, self.meta or (None,) * 3))}


def _splits(kind: LogKind, summary: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, done = None, []
        for batch in batches:
            keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if split is None or (split.file, split.block) != keys[at]:
                    if split is not None:
                        done.append(split.left())
                    split = _Split(*keys[at])
                rows = split.take(batch.column("value").slice(at, end - at), kind)
                if not summary:
                    yield rows
                at = end
        if summary and split is not None:
            yield pa.RecordBatch.from_pylist([*done, split.left()], schema=_LEFT)

    return run


def _carried(left: DataFrame) -> DataFrame:
    """What each split starts with, from what those before it leave."""
    log = left.withColumn("log", F.regexp_extract("file", "^(.*)/[^/]*$", 1))
    before = Window.partitionBy("log").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(column: str):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    log = log.withColumns({"h": so_far("headers"), "l": so_far("lines")})
    log = log.withColumns({"h_mark": F.col("h") + F.col("header_mark"), "l_mark": F.col("l") + F.col("line_mark")})

    def last(column):
        return F.last(column, ignorenulls=True).over(before)

    meta = F.when(F.col("commit").isNotNull(), F.struct(*_META))
    return log.select(
        "file", "block", "log", so_far("records").alias("rec_in"),
        (F.col("h") - F.coalesce(last("h_mark"), F.lit(0))).alias("part_in"),
        (F.col("l") - F.coalesce(last("l_mark"), F.lit(0))).alias("at_in"),
        last("name").alias("name_in"), last(meta).alias("meta_in"),
    )


def _log(spark: SparkSession, path: str, kind: LogKind) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("value"),
    )
    # One row a split, a few hundred bytes for each of the splits that tasks read.
    carried = settle(_carried(rows.mapInArrow(_splits(kind, True), _LEFT_DDL)), "log")
    lines = rows.mapInArrow(_splits(kind, False), _LINES_DDL).join(F.broadcast(carried), ["file", "block"])
    outside = F.col("rec") == 0  # before the first record that starts in the split

    def value(column: str, unknown):
        return F.coalesce(F.col(column), F.col("meta_in")[column], F.lit(unknown).cast("string")).alias(column)

    none_yet = outside & F.col("name").isNull()
    return lines.select(
        F.col("log").alias("log_file"), F.lit(0).cast("bigint").alias("log_block"), (F.col("rec_in") + F.col("rec") - 1).alias("log_row"),
        (F.col("part") + F.when(outside, F.col("part_in")).otherwise(0)).cast("int").alias("part"),
        F.coalesce(F.when(none_yet, F.col("name_in")).otherwise(F.col("name")), F.lit(kind.unnamed)).alias("file"),
        *(value(c, u) for c, u in zip(_META, kind.unknown)),
        (F.col("at") + F.when(F.col("open"), F.col("at_in")).otherwise(0)).cast("int").alias("at"), "line",
    )


def read_log(spark: SparkSession, path: str, kind: LogKind = PATCH_LOG) -> DataFrame:
    """The added lines of a log: ``line`` without its plus sign, what it belongs to, and its place.

    ``log_file`` is the log's folder, ``log_row`` the number of the record, ``part`` that of the file in it and ``at``
    the line's place behind the file's header.  Lines before the first record have number -1.
    """
    return _log(spark, path, kind).filter(F.col("line").isNotNull())


def read_commits(spark: SparkSession, path: str, kind: LogKind = PATCH_LOG) -> DataFrame:
    """``(log_file, log_row, commit, author, date)`` of every record of a log."""
    return _log(spark, path, kind).filter(F.col("line").isNull()).select("log_file", "log_row", *_META)
