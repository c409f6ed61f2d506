"""Helpers the operators share: settled tables, skew-safe joins, bounded slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.plans.settle import shared_dir

HOT_SHARE = 1000
SLICE_BYTES = 8 << 20


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    What follows starts from the files, so a lost executor repeats none of the work before and row numbers
    given once stay as they are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", merge: bool = False
) -> DataFrame:
    """Join ``rows`` with ``groups``, one row for each key, whatever share of the rows one key holds.

    ``size`` names the column of ``groups`` that counts a key's rows, ``total`` is the number of rows.  At most
    ``HOT_SHARE`` keys can hold ``total / HOT_SHARE`` rows or more, so those are broadcast; any other key is too
    small to hold up a task and is shuffled, at any size with ``merge``.  ``how`` is ``inner`` or ``left``.
    """
    bound = total / HOT_SHARE
    hot = groups.filter(F.col(size) >= bound)
    rest = groups.filter(F.col(size) < bound)
    rest = rest.hint("merge") if merge else rest
    fits = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(fits, keys, "left_anti").join(rest, keys, how))


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class Carried:
    """Columns of a table that an operator only passes on, in one struct, so no name of theirs can clash."""

    def __init__(self, docs: DataFrame, without: Collection[str]):
        self.names = [c for c in docs.columns if c not in without]
        fields = (quoted(c).alias(f"c{i}") for i, c in enumerate(self.names))
        self.column = F.struct(F.lit(0).alias("none"), *fields).alias("row")

    def back(self) -> dict[str, Column]:
        """Each of them by its name, from the struct ``row``."""
        return {c: F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(self.names)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in ``column``; a longer value makes a part of its own.

    After the last part, what the memory pool holds and no array uses goes back to the system, as workers live on.
    """
    start = used = 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    for row, size in enumerate(sizes):
        if row > start and used + size > limit:
            yield batch.slice(start, row - start)
            start, used = row, 0
        used += size
    if batch.num_rows > start:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def in_slices(function, column: str, schema: pa.Schema, limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function that gives ``function`` parts of bounded size and casts what it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                made = function(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)

    return run
