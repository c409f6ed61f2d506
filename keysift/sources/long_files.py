"""Files too long for one row: read as lines, in ranges of bytes, so that one huge file is work for many tasks."""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keysift.config import AuditConfig
from keysift.operators.lines import SAMPLE_BYTES, is_binary
from keysift.plans.settle import settle
from keysift.sources.files import listed_root, tree_listing
from keysift.sources.walk import CHUNK_BYTES, _spread, attempt, open_root

LONG_BYTES = 256 << 20
RANGE_BYTES = 32 << 20
_END = re.compile(rb"[\r\n]")


def _heads(root: str):
    def head(system, path: str) -> bytes:
        with system.open_input_stream(path) as stream:
            return stream.read(SAMPLE_BYTES)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        for batch in batches:
            made = [attempt(lambda: head(system, f"{base}/{path}")) for path in batch["path"]]
            yield batch.assign(head=[data for data, _ in made], reason=pd.Series([why for _, why in made], dtype=object))

    return read


def _read_through(root: str, size: int):
    """Each range read whole, in chunks: its first bytes, how many it has, and why it could not be read if so."""

    def through(system, path: str, start: int) -> tuple[bytes, int]:
        head, n = b"", 0
        with system.open_input_file(path) as stream:
            stream.seek(start)
            while n < size and (chunk := stream.read(min(CHUNK_BYTES, size - n))):
                head, n = head or chunk[:SAMPLE_BYTES], n + len(chunk)
        return head, n

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        for batch in batches:
            made = [
                attempt(lambda: through(system, f"{base}/{path}", number * size))
                for path, number in zip(batch["path"], batch["range"])
            ]
            yield batch.assign(
                head=[None if found is None else found[0] for found, _ in made],
                n=[0 if found is None else found[1] for found, _ in made],
                reason=pd.Series([why for _, why in made], dtype=object),
            )

    return read


def _ranges(files: DataFrame, size: int) -> DataFrame:
    last = F.floor((F.col("length") - 1) / size).cast("bigint")
    return files.filter(F.col("length") > 0).select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range")
    )


def read_ranges(files: DataFrame, root: str, size: int = RANGE_BYTES) -> DataFrame:
    """``(path, length, n, binary, reason)`` of ``files(path, length)`` below the root, read whole in ranges of ``size`` bytes.

    ``n`` counts the bytes read.  A file of which a range cannot be read has null ``binary`` and the reason.  No
    worker holds more than a chunk of a range, however long the file.
    """
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    read = _spread(_ranges(files, size), total).mapInPandas(
        _read_through(root, size), "path STRING, length BIGINT, range BIGINT, head BINARY, n BIGINT, reason STRING"
    )
    whole = read.groupBy("path", "length").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("range") == 0, F.col("head"))).alias("head"), F.max("reason").alias("reason")
    )
    binary = F.when(F.col("reason").isNull(), is_binary(F.col("head")))
    return whole.select("path", "length", "n", binary.alias("binary"), "reason")


def long_files(files: DataFrame, root: str, written: list[str] | None = None) -> DataFrame:
    """``(path, length, binary, reason)`` of ``files(path, length)``; one that cannot be read counts as binary."""
    heads = _spread(files.select("path", "length")).mapInPandas(
        _heads(root), "path STRING, length BIGINT, head BINARY, reason STRING"
    )
    binary = F.coalesce(is_binary(F.col("head")), F.lit(True))
    return settle(heads.select("path", "length", binary.alias("binary"), "reason"), "long", written)


def line_starts(data: bytes, offset: int, start: int, end: int, length: int) -> np.ndarray:
    """Where lines start from ``start`` up to ``end`` in a file of ``length`` bytes.

    ``data`` stands at ``offset`` and reaches from the byte before ``start`` to the one at ``end``, as far as they
    exist, so a carriage return and a newline that two ranges share end one line.
    """
    here = np.frombuffer(data, np.uint8)
    after = np.append(here[1:], 0)
    found = np.flatnonzero((here == 10) | ((here == 13) & (after != 10))) + (offset + 1)
    found = found[(found >= start) & (found < min(end, length))]
    return np.append(0, found) if start == 0 and length else found


def _opened(system, path: str, row: dict, size: int):
    """The range's bytes with a neighbour on each side, its end, and the stream, which stands behind them."""
    start = row["range"] * size
    end, offset = min(start + size, row["length"]), max(start - 1, 0)
    stream = system.open_input_file(path)
    stream.seek(offset)
    return stream, stream.read(min(end + 1, row["length"]) - offset), offset, start, end


def _count_starts(root: str, size: int):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_root(root)
        for batch in batches:
            counts = []
            for row in batch.to_dict("records"):
                stream, data, offset, start, end = _opened(system, f"{base}/{row['path']}", row, size)
                stream.close()
                counts.append(len(line_starts(data, offset, start, end, row["length"])))
            yield batch.assign(n=counts)

    return counted


def _range_lines(root: str, size: int):
    """Numbered lines that start in a range; the last one is read on to its end."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        for batch in batches:
            for row in batch.to_pylist():
                stream, data, offset, start, end = _opened(system, f"{base}/{row['path']}", row, size)
                with stream:
                    starts = (line_starts(data, offset, start, end, row["length"]) - offset).tolist()
                    if not starts:
                        continue
                    at = _END.search(data, starts[-1])
                    more = []
                    while at is None and (chunk := stream.read(CHUNK_BYTES)):
                        at = _END.search(chunk)
                        more.append(chunk if at is None else chunk[: at.start()])
                last = b"".join([data[starts[-1] :], *more]) if at is None or more else data[starts[-1] : at.start()]
                whole = [data[a:b] for a, b in zip(starts, starts[1:])]
                yield from _numbered(row["path"], row["before"], [x[: -2 if x.endswith(b"\r\n") else -1] for x in whole] + [last])

    return lines


def _numbered(path: str, before: int, lines: list[bytes], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(lines), rows):
        part = lines[at : at + rows]
        numbers = np.arange(before + at + 1, before + at + 1 + len(part), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * len(part), pa.string()), pa.array(numbers), pa.array(part, pa.binary())], ["path", "line_number", "value"]
        )


def range_lines(files: DataFrame, root: str, size: int = RANGE_BYTES, written: list[str] | None = None) -> DataFrame:
    """``(path, line_number, line)`` of ``files(path, length)`` below the root, each range of ``size`` bytes by itself.

    Lines belong to the range they start in.  They are counted for each range first, and a line's number is its
    place in its range plus the counts of the ranges before.  A file that cannot be read ends the job.
    """
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    counts = _spread(_ranges(files, size), total).mapInPandas(_count_starts(root, size), "path STRING, length BIGINT, range BIGINT, n BIGINT")
    counts = settle(counts, "ranges", written)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = settle(counts.withColumn("before", before).filter("n > 0"), "ranges", written)
    rows = _spread(placed, total).mapInArrow(_range_lines(root, size), "path STRING, line_number INT, value BINARY")
    return rows.select("path", "line_number", F.make_valid_utf8(F.col("value").cast("string")).alias("line"))


def long_parts(
    spark: SparkSession, root: str, config: AuditConfig = AuditConfig(), least: int = LONG_BYTES,
    listing: DataFrame | None = None, size: int = RANGE_BYTES, written: list[str] | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """Files of ``least`` bytes or more, and their lines, or nothing when the root holds none.

    The lines are read for matches, for the lines near those, and to count them; they are not copied for that.
    """
    listing = tree_listing(spark, root, config, written) if listing is None else listing
    if listing is None:
        return None
    base = listed_root(spark, root)
    files = long_files(listing.filter(F.col("reason").isNull() & (F.col("length") >= least)), base, written)
    if files.isEmpty():
        return None
    return files, range_lines(files.filter(~F.col("binary")), base, size, written)
