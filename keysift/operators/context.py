"""Context of matched lines when lines are rows, not arrays: for inputs too long to hold a file in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


BLOCK_LINES = 64
MOST_BLOCKS = 500_000  # of lines near hits, to be broadcast


def _blocks(hits: DataFrame, lines: DataFrame, size: int) -> DataFrame:
    """``(path, block, around)`` of the blocks that hold a hit: their lines and ``size`` more on both sides, in order.

    Hits are few beside lines, so their blocks are counted and, up to ``MOST_BLOCKS``, broadcast: then all other
    lines are dropped where they are read, and a line near a hit is shuffled once, or twice near the end of a block.
    """
    wanted = hits.select("path", "block").distinct()
    if wanted.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS:
        wanted = F.broadcast(wanted)
    place = F.col("line_number") - 1
    reach = F.sequence(F.floor((place - size) / BLOCK_LINES), F.floor((place + size) / BLOCK_LINES))
    near = lines.select("path", "line_number", "line", F.explode(reach).alias("block"))
    near = near.join(wanted, ["path", "block"], "left_semi")
    around = F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("around")
    return near.groupBy("path", "block").agg(around)


def join_context(hits: DataFrame, lines: DataFrame, size: int = 20) -> DataFrame:
    """Add ``lines_before`` and ``lines_after`` to ``hits(path, line_number, ...)`` from ``lines(path, line_number, line)``.

    Lines are gathered once for each block with a hit, however many hits it holds, and a hit cuts its context out of
    its block: an equi-join on (path, block), so one huge file spreads over all tasks and a row holds
    ``BLOCK_LINES + 2 * size`` lines at most.
    """
    placed = hits.withColumn("block", F.floor((F.col("line_number") - 1) / BLOCK_LINES))
    found = placed.join(_blocks(placed, lines, size), ["path", "block"], "left")
    at = F.col("line_number") - F.get("around", F.lit(0))["line_number"] + 1
    first = F.greatest(at - size, F.lit(1))

    def cut(start: Column, length: Column) -> Column:
        part = F.transform(F.slice("around", start, length), lambda x: x["line"])
        return F.coalesce(part, F.array().cast("array<string>"))

    before, after = cut(first, at - first), cut(at + 1, F.lit(size))
    return found.select(*(c for c in hits.columns), before.alias("lines_before"), after.alias("lines_after"))
