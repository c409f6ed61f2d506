r"""Exported version-control history.

The log is the text of ``git log --all -p --full-history --no-merges -U3 --format='COMMIT:%H|%an|%ad'``.  One
commit is one record: inside a patch every content line starts with a space, ``+`` or ``-``, so only a header
follows a line end with ``COMMIT:``.  Stashes are exported the same way, each under ``STASH:<stash list line>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Line ends of Python's str.splitlines, other than the newline.
_OTHER_ENDS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                            0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LOG_HEADER = r'(?=--- "?a/|\+\+\+ "?b/)'
_STASH_HEADER = r'(?=\+\+\+ "?b/)'
COMMIT_CHARS = 8
STRETCH = 4096  # rows of a log whose last header is found first
UNKNOWN = {"commit": "HEAD", "author": "Unknown", "date": "Unknown"}


def _read_records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """One row per record.  The text source has no row numbers; file, block and row order the records."""
    rows = spark.read.option("lineSep", f"\n{mark}").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("log_block"),
        F.monotonically_increasing_id().alias("log_row"),
        F.when(F.startswith("value", F.lit(mark)), F.substring("value", len(mark) + 1, 1 << 30))
        .otherwise(F.col("value")).alias("record"),
    )


def read_patch_log(spark: SparkSession, path: str) -> DataFrame:
    return _read_records(spark, path, "COMMIT:")


def read_stash_log(spark: SparkSession, path: str) -> DataFrame:
    return _read_records(spark, path, "STASH:")


def _plain_ends(text: Column) -> Column:
    """The text with newlines as its only line ends; few records hold any other, so test before replacing."""
    other = text.rlike(r"[\r\x0b\x0c\x1c\x1d\x1e\x85]") | (
        (F.octet_length(text) > F.length(text)) & text.rlike(r"[\u2028\u2029]")
    )
    return F.when(other, F.regexp_replace(text, _OTHER_ENDS, "\n")).otherwise(text)


def _first_line(text: Column) -> Column:
    return F.substring_index(_plain_ends(F.substring_index(text, "\n", 1)), "\n", 1)


def _header_meta() -> tuple[Column, Column]:
    """Commit, author and date of a record's header, and whether it has all three."""
    parts = F.split(_first_line(F.col("record")), r"\|")
    values = F.substring(F.get(parts, F.lit(0)), 1, COMMIT_CHARS), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    return F.struct(*(value.alias(name) for name, value in zip(UNKNOWN, values))), F.size(parts) >= 3


def commit_meta(records: DataFrame) -> DataFrame:
    """Add ``commit``, ``author`` and ``date`` from the header.  A header of fewer than three parts names none."""
    meta, whole = _header_meta()
    return records.withColumns({c: F.when(whole, meta[c]).otherwise(unknown) for c, unknown in UNKNOWN.items()})


def carried_meta(records: DataFrame) -> DataFrame:
    """``commit_meta``, but a header of fewer than three parts keeps the values of the last whole one in its log.

    Records are ordered by block and row.  The last whole header of each stretch of ``STRETCH`` rows goes to the
    stretches behind it, and only stretches with a short header are looked into; no texts are moved but those of
    records with a short header.
    """
    meta, whole = _header_meta()
    place, stretch = ["log_file", "log_block", "log_row"], ["log_file", "log_block", "stretch"]
    slim = records.select(*place, F.floor(F.col("log_row") / STRETCH).alias("stretch"), F.when(whole, meta).alias("meta"))
    known = F.col("meta").isNotNull()
    ends = slim.groupBy(*stretch).agg(
        F.max_by("meta", F.when(known, F.col("log_row"))).alias("last"), F.count_if(~known).alias("short")
    )
    so_far = Window.partitionBy("log_file").orderBy("log_block", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("before", F.last("last", ignorenulls=True).over(so_far)).filter("short > 0").select(*stretch, "before")
    own = Window.partitionBy(*stretch).orderBy("log_row")
    inside = slim.join(starts, stretch).withColumn("held", F.coalesce(F.last("meta", ignorenulls=True).over(own), "before"))
    held = inside.filter(~known).select(*place, "held")
    short = records.filter(~whole).join(held, place, "left").withColumns(
        {c: F.coalesce(F.col("held")[c], F.lit(unknown)) for c, unknown in UNKNOWN.items()}
    )
    full = records.filter(whole).withColumns({c: meta[c] for c in UNKNOWN})
    return full.unionByName(short.select(*full.columns))


def stash_meta(records: DataFrame) -> DataFrame:
    """Add the stash id as ``commit``: what stands before the first colon of the list line."""
    head = _first_line(F.col("record"))
    return records.withColumn(
        "commit",
        F.when(F.contains(head, F.lit(":")), F.btrim(F.substring_index(head, ":", 1), F.lit(_BLANKS))).otherwise("stash@{0}"),
    )


def _header_path(header: Column) -> Column:
    """Path in a file header; git puts a path with unusual characters in quotes."""
    path = F.btrim(F.substring(header, 7, 1 << 30), F.lit(_BLANKS))
    quoted = F.regexp_replace(F.substring(header, 8, 1 << 30), r'"\s*$', "")
    return F.when(F.substring(header, 5, 1) == '"', quoted).otherwise(path)


def file_segments(records: DataFrame, *, stash: bool = False) -> DataFrame:
    """One row per stretch of a record that belongs to one file: ``part``, ``file`` and its ``segment`` of text.

    A header names the file of all lines up to the next header, so cutting the record before each header
    carries the name forward without a window over the log.
    """
    header = _STASH_HEADER if stash else _LOG_HEADER
    rows = records.select(
        *(c for c in records.columns if c != "record"),
        F.posexplode(F.split(_plain_ends(F.col("record")), "\n" + header)).alias("part", "segment"),
    )
    named = F.when(F.col("part") > 0, _header_path(_first_line(F.col("segment"))))
    return rows.withColumn("file", named.otherwise("Stash Diff" if stash else "Unknown"))


def added_lines(segments: DataFrame) -> DataFrame:
    """One row per added line, in ``line`` without its plus sign; ``at`` is its place in the segment."""
    others = [c for c in segments.columns if c != "segment"]
    rows = segments.select(*others, F.posexplode(F.split("segment", "\n")).alias("at", "_line"))
    rows = rows.filter(F.col("_line").startswith("+") & ~F.col("_line").startswith("+++"))
    # The plus sign is one byte, and bytes are cut without counting characters.
    cut = F.substring(F.col("_line").cast("binary"), 2, 1 << 30).cast("string")
    return rows.withColumn("line", cut).drop("_line")


def patch_lines(records: DataFrame) -> DataFrame:
    return added_lines(file_segments(commit_meta(records)))


def stash_lines(records: DataFrame) -> DataFrame:
    return added_lines(file_segments(stash_meta(records), stash=True))
